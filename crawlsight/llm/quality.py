"""Document quality by hierarchical empirical Bayes.

A classifier, fitted on a bounded sample of labelled documents, gives each document's own evidence. Over all
documents, grouped sums give each host and each path of a host a posterior share of good documents: a host
with few documents is shrunk toward the global share, a path toward its host. A document's score is its own
log-odds moved by how far its path's posterior departs from the global share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, slices

#: Labelled documents that the classifier is fitted on, at most; those with the smallest hash of their doc_id.
SAMPLE = 12_000
#: Words that stand for a label, at most; how many standard errors they must be from chance.
WORDS, ERRORS = 500, 3.5
#: The most by which a site may move a document's log-odds, and the bounds of the shrinkage (in documents).
SITE_LIMIT, LEAST_SHRINK, MOST_SHRINK = 1.0, 20.0, 10_000.0
#: Paths up to this many (a few numbers each) are sent to every executor.
SENT_PATHS = 500_000

_KIND = np.full(256, 5)
_KIND[[*range(65, 91)]] = 0
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_WORD_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SHAPES = 11


def features(text: str | None) -> tuple[list[float], set[bytes]]:
    """Shape numbers of a whole text, and its distinct words (letters and digits, A-Z in lower case)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw:
        return [0.0] * SHAPES, set()
    kinds = np.bincount(_KIND[np.frombuffer(raw, "u1")], minlength=6) / len(raw)
    words = raw.lower().translate(_WORD_BYTES).split()
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = kinds[0] + kinds[1] + kinds[5]
    return [
        *kinds[[0, 2, 3, 4, 5]].tolist(), kinds[0] / letters if letters else 0.0,
        len(distinct) / len(words) ** 0.8 if words else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        raw.count(b"|") / len(raw), len(raw) / (len(raw.split()) or 1) / 10, math.log10(len(raw)),
    ], distinct


@dataclass(frozen=True)
class Model:
    """Log-odds from shapes and words, for good quality and for toxicity."""

    mean: np.ndarray
    spread: np.ndarray
    shape: np.ndarray  # (2, SHAPES)
    bias: np.ndarray
    words: dict[int, tuple[float, float]]

    def log_odds(self, text: str | None) -> tuple[float, float]:
        shapes, words = features(text)
        q, t = self.bias + self.shape @ np.clip((np.array(shapes) - self.mean) / self.spread, -8, 8)
        known = self.words
        for w in words:
            if hit := known.get(xxhash.xxh3_64_intdigest(w)):
                q += hit[0]
                t += hit[1]
        return float(np.clip(q, -30, 30)), float(np.clip(t, -30, 30))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge, by Newton steps over parts of the rows; the last weight is the bias."""
    ridge = np.full(x.shape[1] + 1, 0.5)
    ridge[-1] = 1e-3
    w = np.zeros(len(ridge))
    for _ in range(25):
        gram, pull = np.diag(ridge), -ridge * w
        for at in range(0, len(x), 1000):
            part = np.hstack([x[at : at + 1000].astype("f8"), np.ones((len(x[at : at + 1000]), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gram += (part * (p * (1 - p))[:, None]).T @ part
            pull += part.T @ (y[at : at + 1000] - p)
        step = np.linalg.solve(gram, pull)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


_FEATURES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("shapes", pa.list_(pa.float64())), ("codes", pa.list_(pa.int64()))])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [features(t) for t in batch[2].to_pylist()]
        codes = [np.fromiter(map(xxhash.xxh3_64_intdigest, w), "u8", len(w)).view("i8") for _, w in found]
        yield pa.RecordBatch.from_arrays(
            [batch[0], batch[1], pa.array([s for s, _ in found], pa.list_(pa.float64())), pa.array(codes, pa.list_(pa.int64()))], schema=_FEATURES
        )


def _telling(words: DataFrame, label: str, n: int, ones: int) -> list[int]:
    """The words (code, c, and how many with each label) whose documents' labels depart most from chance."""
    one, zero = F.col(label), F.col("c") - F.col(label)
    p = F.col("c") / n
    z = F.abs(one / ones - zero / (n - ones)) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / ones + 1 / (n - ones)))
    return sorted(r["code"] for r in words.select("code", z.alias("z")).where(F.col("z") > ERRORS).orderBy(F.desc("z"), "code").limit(WORDS).collect())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, store: Store | None = None) -> Model:
    """Fit on at most ``sample`` documents that ``labels`` (doc_id, quality, toxic, more) name.

    Words are counted in Spark; the driver gets the sample's shapes and which of at most 2 x WORDS words each
    document has. Of several labels of a doc_id the worse counts; of several texts that with the smallest hash.
    Without rows, or with one class only, that class is certain: everything is good and nothing toxic without labels.
    """
    store = store or Store(docs.sparkSession, "quality")
    usable = labels.select("doc_id", "quality", "toxic").where("doc_id is not null and quality is not null and toxic is not null")
    chosen = store.put(
        usable.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("q"), F.max(F.col("toxic").cast("int")).alias("t"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "chosen",
    )
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").mapInArrow(
        _taken, "doc_id long, h long, shapes array<double>, codes array<long>"
    )
    rows = store.put(
        found.groupBy("doc_id").agg(F.min_by(F.struct("shapes", "codes"), "h").alias("f")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "q", "t", "f.shapes", "f.codes"), "sample",
    )
    totals = rows.agg(F.count(F.lit(1)), F.sum("q"), F.sum("t")).first()
    n, ones = totals[0], [totals[1] or 0, totals[2] or 0]
    shape, bias, words = np.zeros((2, SHAPES)), np.array([30.0, -30.0]), {}
    if not n:
        return Model(np.zeros(SHAPES), np.ones(SHAPES), shape, bias, words)
    counted = store.put(
        rows.select("q", "t", F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("c"), F.sum("q").alias("q"), F.sum("t").alias("t")).where("c >= 5"), "words"
    )
    telling = [_telling(counted, c, n, k) if 0 < k < n else [] for c, k in zip("qt", ones, strict=True)]
    wanted = F.array(*map(F.lit, sorted({*telling[0], *telling[1]}))).cast("array<long>")
    got = rows.select("q", "t", "shapes", F.array_intersect("codes", wanted).alias("has")).toArrow()
    shapes = np.array(got["shapes"].to_pylist(), "f8").reshape(-1, SHAPES)
    mean, spread = shapes.mean(0), shapes.std(0) + 1e-6
    scaled = np.clip((shapes - mean) / spread, -8, 8).astype("f4")
    has = got["has"].to_pylist()
    for k in range(2):
        y = got["qt"[k]].to_numpy().astype(bool)
        if y.all() or not y.any():
            bias[k] = 30.0 if y[0] else -30.0
            continue
        column = {code: SHAPES + i for i, code in enumerate(telling[k])}
        x = np.zeros((n, SHAPES + len(column)), "f4")
        x[:, :SHAPES] = scaled
        for i, codes in enumerate(has):
            x[i, [column[c] for c in codes if c in column]] = 1
        w = _fit(x, y)
        shape[k], bias[k] = w[:SHAPES], w[-1]
        for code, weight in zip(telling[k], w[SHAPES:-1].tolist(), strict=True):
            code &= (1 << 64) - 1
            old = words.get(code, (0.0, 0.0))
            words[code] = (weight, old[1]) if k == 0 else (old[0], weight)
    return Model(mean, spread, shape, bias, words)


def evidence(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with _q and _t, each document's own log-odds of quality and toxicity."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(keep or docs.columns)
    source = docs.select(*columns, F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            odds = np.array([shared.value.log_odds(t) for t in batch["_text"].to_pylist()], "f8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(odds[:, 0]), pa.array(odds[:, 1])], names=[*batch.schema.names[:-1], "_q", "_t"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    return source.mapInArrow(run, f"{schema}, _q double, _t double")


def site_shifts(scored: DataFrame) -> DataFrame:
    """(host, path, site_shift): how far the posterior of each path moves the log-odds, from all of ``scored`` (host, path, _q)."""
    p = 1 / (1 + F.exp(-F.col("_q")))
    paths = scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    # between-host variance of the mean, less what sampling alone would give: the prior's strength by moments
    r = hosts.agg(
        F.sum("hn").alias("n"), F.sum("hgood").alias("good"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.pow(F.col("hgood"), 2) / F.col("hn")).alias("squares"),
    ).first()
    n = r["n"] or 0
    mean = min(max((r["good"] or 0) / n if n else 0.5, 1e-4), 1 - 1e-4)
    between = max(((r["squares"] or 0) - n * mean**2) / n - mean * (1 - mean) * r["hosts"] / n, 0.0) if n else 0.0
    shrink = min(max(mean * (1 - mean) / between - 1, LEAST_SHRINK), MOST_SHRINK) if between > 0 else MOST_SHRINK
    hosts = hosts.select("host", ((F.col("hgood") + shrink * mean) / (F.col("hn") + shrink)).alias("host_share"))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
    share = (F.col("good") + shrink * F.col("host_share")) / (F.col("n") + shrink)
    share = F.least(F.greatest(share, F.lit(1e-4)), F.lit(1 - 1e-4))
    shift = F.log(share / (1 - share)) - math.log(mean / (1 - mean))
    return both.select(
        F.col("p.host").alias("host"), F.col("p.path").alias("path"),
        F.greatest(F.lit(-SITE_LIMIT), F.least(F.lit(SITE_LIMIT), shift)).alias("site_shift"),
    )


def judge(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE, keep: tuple[str, ...] | None = None
) -> DataFrame:
    """``docs`` (doc_id, text, host, path, more) with p_quality, p_toxic, site_shift and kept (good and not toxic).

    Null and empty texts are judged by their shape; null hosts and paths are sites of their own; repeated rows
    are judged each; no rows give no rows. Texts are read once; what a document's own evidence is, is stored.
    """
    columns = tuple(keep or docs.columns)
    store = Store(docs.sparkSession, "quality")
    model = fit(docs, labels, sample, store)
    # the columns kept travel in one value, so that none of their names clashes with ours
    site = docs.select(F.struct(*columns).alias("kept_row"), F.col(host).alias("host"), F.col(path).alias("path"), "text")
    scored = store.put(evidence(site, model, ("kept_row", "host", "path")), "scored")
    shifts = store.put(site_shifts(scored), "shifts").select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "site_shift")
    here = F.broadcast(shifts) if shifts.count() <= SENT_PATHS else shifts
    both = scored.join(here, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    shift = F.coalesce(F.col("site_shift"), F.lit(0.0))
    logit = F.col("_q") + shift
    store.drop("chosen", "sample", "words")
    return both.select(
        *(F.col("kept_row").getField(c).alias(c) for c in columns), (1 / (1 + F.exp(-logit))).alias("p_quality"), (1 / (1 + F.exp(-F.col("_t")))).alias("p_toxic"),
        shift.alias("site_shift"), ((logit >= 0) & (F.col("_t") < 0)).alias("kept"),
    )
