"""Errors of plans and operators; each has a code that callers can tell apart."""

from __future__ import annotations


class NewsError(Exception):
    """code, message and details of what went wrong."""

    code = "PIPELINE_FAILURE"

    def __init__(self, message: str, **details: object) -> None:
        super().__init__(message.strip() or "unknown error")
        self.details = details


class InvalidInput(NewsError, ValueError):
    code = "INVALID_INPUT"


class InvalidConfig(NewsError, ValueError):
    code = "INVALID_CONFIG"


class InvalidArticle(NewsError, ValueError):
    code = "INVALID_ARTICLE"


class ScoringFailure(NewsError):
    code = "SCORING_FAILURE"


class ClusteringFailure(NewsError):
    code = "CLUSTERING_FAILURE"
