"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary dictionary.

Training (on a bounded sample of labelled rows, see ``SAMPLE``): two dictionaries are trained with
zstandard, one on windows of ordinary documents, one on the words, with their blanks, that are over-
represented in toxic ones. The classifier's toxic dictionary is the toxic content in front of the
ordinary one, its ordinary dictionary the ordinary content alone, so that text that both explain
has the same length under both and only toxic wording makes a difference. Two thirds of the sample
train the dictionaries; the rest sets the window threshold (a quantile of the ordinary windows'
length differences) and fits the logistic calibration of a document's summary to its label.

Scoring: every whole text, in lower case, is cut into windows of ``WINDOW`` bytes, ``STEP`` apart.
The summary is the mean, sum and largest of the lengths saved, and the rate of windows over the
threshold. Scores need only the dictionaries and a few numbers, which have a fixed size.

Bounds: the toxic content is at most ``TOXIC_BYTES`` of words of three letters or more that ``SEEN``
toxic documents or more hold, ``ODDS`` times over-represented; toxicity in phrases of ordinary words,
in short words or in words with digits isn't seen. The ordinary dictionary is trained on at most
30,000 windows, drawn at random. With fewer than 80 uses of such words, fewer than 200 ordinary
windows, calibration rows of one kind only, or too little text for zstandard, no dictionary is
trained and every score is the share of toxic labels.

Defined cases: null and empty texts have nothing saved and get the score of that. Labels without a
document and null labels are ignored; without labels of both kinds every score is the share of
toxic labels. Repeated rows get equal scores. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents

WINDOW, STEP = 64, 52
LEVEL = 12
ORDINARY_BYTES, TOXIC_BYTES = 100_000, 6_000
#: Most labelled rows of each kind (toxic, ordinary) that training takes: those with the smallest hash of their id.
SAMPLE = (3000, 6000)
ODDS, SEEN = 10, 3
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]{3,}")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    cut: float
    mean: list[float]
    scale: list[float]
    weights: list[float]
    base: float

    def scorer(self):
        """A function from a text to its score."""
        if not self.toxic:
            return lambda text: self.base
        with_toxic, alone = _compressor(self.toxic), _compressor(self.ordinary)
        mean, scale, weights = np.array(self.mean), np.array(self.scale), np.array(self.weights)

        def score(text: str | None) -> float:
            x = (summary(saved(with_toxic, alone, text), self.cut) - mean) / scale
            return float(1 / (1 + np.exp(-(x @ weights[1:] + weights[0]))))

        return score


def _compressor(content: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def saved(with_toxic, alone, text: str | None) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of the text."""
    import zstandard

    data = (text or "").lower().encode("utf-8", "replace")
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    out = []
    for a in range(0, len(starts), 4096):
        s = starts[a : a + 4096]
        windows = zstandard.BufferWithSegments(data, np.stack([s, np.minimum(WINDOW, n - s)], 1).astype("<u8").tobytes())
        sizes = [np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=1)), np.int64, len(s)) for c in (alone, with_toxic)]
        out.append(sizes[0] - sizes[1])
    return np.concatenate(out)


def summary(d: np.ndarray, cut: float) -> np.ndarray:
    p = np.maximum(d, 0)
    return np.log1p([10 * p.mean(), p.sum(), p.max(), 100 * (d > cut).mean(), (d > cut).sum()])


def _windows(text: str) -> list[bytes]:
    data = text.lower().encode("utf-8", "replace")
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data) - WINDOW + STEP), STEP)]


def train(rows: list[tuple[str, int]], seed: int = 1) -> Model:
    """Fit the classifier to (text, toxic) rows."""
    import zstandard

    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    fit, rest = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    base = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    nothing = Model(b"", b"", 0, [], [], [], base)
    toxic, ordinary = Counter(), Counter()
    for text, y in fit:
        (toxic if y else ordinary).update(set(WORD.findall(text.lower())))
    nt, no = sum(y for _, y in fit), sum(1 - y for _, y in fit)
    telling = {w for w, c in toxic.items() if c >= SEEN and (c + 0.3) / (nt + 1) > ODDS * (ordinary[w] + 0.3) / (no + 1)}
    # Every telling word as often as it occurs, eight to a sample.
    said = [f" {w} ".encode() for text, y in fit if y for w in WORD.findall(text.lower()) if w in telling]
    plain = [w for text, y in fit if not y for w in _windows(text)]
    if len(said) < 80 or len(plain) < 200 or len({y for _, y in rest}) < 2:
        return nothing
    plain = [plain[i] for i in rng.permutation(len(plain))[:30_000]]
    try:
        alone = zstandard.train_dictionary(min(ORDINARY_BYTES, sum(map(len, plain)) // 8), plain, k=32, d=6).as_bytes()
        words = zstandard.train_dictionary(min(TOXIC_BYTES, sum(map(len, said)) // 2), [b"".join(said[i : i + 8]) for i in range(0, len(said), 8)], k=16, d=6).as_bytes()
    except zstandard.ZstdError:  # too little text for a dictionary
        return nothing
    c = _compressor(words + alone), _compressor(alone)
    found = [saved(*c, text) for text, _ in rest]
    y = np.array([y for _, y in rest], float)
    cut = float(np.quantile(np.concatenate([d for d, v in zip(found, y, strict=True) if not v]), 0.99))
    x = np.array([summary(d, cut) for d in found])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(30):  # Newton's method
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-6 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
    return Model(words + alone, alone, cut, mean.tolist(), scale.tolist(), w.tolist(), base)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """At most ``SAMPLE`` labelled rows of each kind that aren't held out, with their texts."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(n) for y, n in ((1, SAMPLE[0]), (0, SAMPLE[1]))]
    ids = picked[0].union(picked[1])
    found = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("t")).join(F.broadcast(ids), id_col)
    # Of an id's several texts the smallest is taken, so that a model doesn't depend on partitions.
    return sorted((r.t, r.y) for r in found.groupBy(id_col).agg(F.min("t").alias("t"), F.first("y").alias("y")).select("t", "y").collect())


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ``score`` and ``predicted`` for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            texts = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(texts[i].as_py()) for i in range(b.num_rows)], pa.float64())], names=["doc_id", "score"])

    out = docs.select(id_col, text_col).mapInArrow(of, f"doc_id {id_type}, score double").withColumnRenamed("doc_id", id_col)
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
