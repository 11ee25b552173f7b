"""Language ID by compression: a text belongs to the language whose zstandard raw-content dictionary packs it smallest.

The dictionaries are fitted on a bounded sample: about `sample_rows` texts of each language, chosen by a hash of the id,
`slice_chars` characters from the middle of each, and at most `dictionary_bytes` in all. Prediction reads whole texts, in pieces of
`piece_bytes` that are packed each by itself and whose sizes are summed: a dictionary saves a bounded number of bytes of
what is packed with it, so over a whole text the margin would fall with the length.

Edge cases: null texts and texts without a letter are `und` with score 0 and are rejected; rows with a null language are
not learned from but are predicted; equal sizes go to the first language by name, with score 0; with a single learned
language the score is 1, with none every text is `und`; repeated rows get equal predictions; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import bound_batches

NOT_LETTERS = re.compile(r"[\W\d_]+")
#: The most bytes of dictionaries that are sent to the tasks: those of about 600 languages of full size.
MOST_BYTES = 1 << 26


def normalized(text: str) -> str:
    """Lower case, and one space for every run of what isn't a letter: case and symbols tell nothing of a language."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


def fit(
    labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 400, slice_chars: int = 600, dictionary_bytes: int = 112_000
) -> dict[str, bytes]:
    """A dictionary of each language, from a bounded sample; languages are as many as the labels have."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    steps = 1 << 30
    share = spark.createDataFrame([(k, int(min(1.0, 1.5 * sample_rows / n) * steps)) for k, n in counts.items()], "lang string, below long")
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps))
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - slice_chars) / 2).cast("int"))
    sample = rows.withColumn("h", h).join(F.broadcast(share), "lang").where(F.col("h") < F.col("below"))
    found = sample.select("lang", "h", F.substr("text", middle, F.lit(slice_chars)).alias("text")).collect()
    out: dict[str, bytes] = {}
    for k in sorted(counts):
        chosen = sorted((r["h"], r["text"]) for r in found if r["lang"] == k)[:sample_rows]
        out[k] = " ".join(normalized(t) for _, t in chosen).encode()[:dictionary_bytes]
    out = {k: v for k, v in out.items() if len(v) >= 8}
    if sum(map(len, out.values())) > MOST_BYTES:
        raise ValueError(f"the dictionaries of {len(out)} languages are too large to send to every task")
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text", min_margin: float = 0.01, level: int = 9, keep: bool = False, piece_bytes: int = 8192) -> DataFrame:
    """doc_id, lang_pred, score (the share by which the second smallest size exceeds the smallest) and rejected.

    keep: with all columns of docs; theirs of the same names go.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packers = []
        for name, content in sorted(shared.value.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            packers.append((name, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))

        def judged(value: str | None) -> tuple[str, float, bool]:
            body = normalized(value).encode() if isinstance(value, str) else b""
            if not packers or not any(map(str.isalpha, body.decode())):  # number characters such as fractions are no letters
                return "und", 0.0, True
            totals = [0] * len(packers)
            for k in range(0, len(body), piece_bytes):
                piece = body[k : k + piece_bytes]
                for i, (_, packer) in enumerate(packers):
                    totals[i] += len(packer.compress(piece))
            sizes = sorted((n, name) for n, (name, _) in zip(totals, packers, strict=True))
            score = 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return sizes[0][1], score, score < min_margin

        for texts in batches:
            yield pd.DataFrame(map(judged, texts), columns=made)

    # Only the text goes to Python, once, and only the result comes back; other columns stay where they are.
    made = ["lang_pred", "score", "rejected"]
    judge = F.pandas_udf(run, "lang_pred string, score double, rejected boolean").asNondeterministic()
    slim = docs.drop(*made) if keep else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    found = slim.withColumn("_found", judge(docs[text] if keep and text in made else F.col(text if keep else "_text")))
    others = [c for c in slim.columns if keep or c != "_text"]
    return found.select(*[F.col(f"`{c}`") for c in others], "_found.lang_pred", "_found.score", "_found.rejected")
