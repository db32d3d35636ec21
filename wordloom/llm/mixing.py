"""Mixing sources to target weights by soft membership.

A classifier learned from a labelled table gives every document posteriors over domains (naive Bayes on
hashed byte 4-grams: mean log-likelihood per n-gram, sharpened, plus the prior). A
document's tokens then belong to each domain by its posterior, and a nonnegative rate per
document is fitted so that the expected tokens per domain meet the targets: least squares by
projected gradient. With ``E_d = sum(rate * tokens * posterior_d)`` the steps are

    rate <- max(0, rate - sum_d posterior_d * g_d),   g = W (E - target)

which is the gradient in the metric that weighs a document by its tokens, with the residual weighted by
W, the inverse of ``sum(tokens * posterior posterior')`` over documents with a rate above zero; a
step that would make the residual larger is halved.
One pass over a table of a few numbers per document sums up E and W; only they, a number and a row
per domain, reach the driver, and rates are recomputed from the steps taken, so a lost task
costs nothing but itself.

Defined results: null and empty texts have no tokens, the prior as posterior, and a rate like
others; rows without a label are not learned from; without any labelled row there are no domains and each rate is
the budget's ratio; a target for a domain nobody belongs to can't be met and shows in
``residual``; domains without a target aim at zero; repeated rows are documents of their own, also where
their posteriors tie; an empty table gives an empty one; very long texts are read whole, in pieces; columns
of the input named like a new one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import BASE, U64, mix, pieces, utf8
from wordloom.llm.tables import shared, without

SLOT_BITS = 15
#: How many n-grams a document's mean log-likelihood counts for: posteriors stay soft.
SHARPNESS = 3.0
STEPS, TOLERANCE = 40, 1e-6


@dataclass
class DomainModel:
    domains: list[str]
    log_likelihood: np.ndarray  # slots x domains
    log_prior: np.ndarray


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the byte 4-grams of padded texts, and the n-grams before each text."""
    n = max(0, len(data) - 3)
    codes = np.ndarray((n,), "<u4", np.ascontiguousarray(data), 0, (1,))
    slots = (mix(codes.astype(U64) * U64(BASE)) >> U64(64 - SLOT_BITS)).astype(np.int64)
    return slots, np.minimum(offsets, n)


def _padded(column: pa.Array) -> pa.Array:
    return utf8(column, lower=True, pad=(b"  ", b"  "))


def _counts(labelled: DataFrame, domains: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(domains << SLOT_BITS, np.int64)
        for batch in batches:
            domain = batch.column(0).to_numpy()
            for rows, data, offsets in pieces(_padded(batch.column(1))):
                slots, firsts = _slots(data, offsets)
                of = np.repeat(domain[rows].astype(np.int64), np.diff(firsts))
                sums += np.bincount((of << SLOT_BITS) | slots, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    rows = labelled.select("domain", "text").mapInArrow(run, "at long, n long")
    return rows.groupBy("at").agg(F.sum("n").alias("n"))


def learn_domains(labelled: DataFrame, domain: str = "domain", text: str = "text") -> DomainModel:
    """Learned from all rows with a label and a text; the tables' size is domains x slots."""
    rows = labelled.select(F.col(domain).cast("string").alias("name"), F.col(text).alias("text"))
    rows = rows.where("name is not null and text is not null")
    sizes = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return DomainModel([], np.zeros((1 << SLOT_BITS, 0), np.float32), np.zeros(0))
    number = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)])
    found = _counts(rows.select(number[F.col("name")].alias("domain"), "text"), len(names)).toArrow()
    sums = np.zeros(len(names) << SLOT_BITS)
    sums[found["at"].to_numpy()] = found["n"].to_numpy()
    smooth = sums.reshape(len(names), -1) + 0.5
    likely = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    prior = np.array([sizes[n] for n in names], float)
    return DomainModel(names, np.ascontiguousarray(likely.T, np.float32), np.log(prior / prior.sum()))


def posteriors(docs: DataFrame, model: DomainModel, *keep: str, text: str = "text") -> DataFrame:
    """``keep``, ``n_tokens`` (words between white space), ``posterior``: one number per domain."""
    own = without(docs.select(*keep, F.col(text).alias("text__")), "n_tokens", "posterior")
    names = [c for c in own.columns if c != "text__"]
    shared_model = docs.sparkSession.sparkContext.broadcast(model)
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text__"))
            soft = np.zeros((len(batch), len(model.domains)))
            tokens = np.zeros(len(batch), np.int64)
            for rows, data, offsets in pieces(_padded(column)):
                blank = white[data]
                begins = np.concatenate([[0], np.cumsum(blank[:-1] & ~blank[1:]), [0]])
                begins[-1] = begins[-2]
                tokens[rows] = begins[np.minimum(offsets[1:], len(data) - 1)] - begins[offsets[:-1]]
                slots, firsts = _slots(data, offsets)
                n = np.maximum(np.diff(firsts), 1)
                score = np.tile(model.log_prior, (len(n), 1))
                for d in range(len(model.domains)):
                    sums = np.zeros(len(slots) + 1)
                    np.cumsum(model.log_likelihood[slots, d], out=sums[1:], dtype=np.float64)
                    mean = (sums[firsts[1:]] - sums[firsts[:-1]]) / n
                    score[:, d] += np.where(tokens[rows] > 0, SHARPNESS * mean, 0)
                if score.size:
                    score = np.exp(score - score.max(axis=1, keepdims=True))
                    soft[rows] = score / score.sum(axis=1, keepdims=True)
            flat = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(model.domains)), pa.array(soft.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(tokens), flat],
                names=[*names, "n_tokens", "posterior"],
            )

    schema = T.StructType([*own.drop("text__").schema.fields]).add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))
    return own.mapInArrow(run, schema)


def _rate(start: float, steps: list[np.ndarray]) -> Column:
    """The rate after these steps."""
    if not steps:
        return F.lit(float(start))
    taken = F.array(*[F.array(*[F.lit(float(x)) for x in g]) for g in steps])
    product = lambda g: F.aggregate(
        F.zip_with(F.col("posterior"), g, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(taken, F.lit(float(start)), lambda r, g: F.greatest(F.lit(0.0), r - product(g)))


def fit_rates(
    members: DataFrame, domains: list[str], targets: dict[str, float], budget: float = 1.0,
    steps: int = STEPS, tolerance: float = TOLERANCE,
) -> tuple[Column, np.ndarray, np.ndarray]:
    """The rate as a column of ``members``, the expected tokens per domain, and the targets in tokens.

    ``members`` is a stored table with ``n_tokens`` and ``posterior``; it is read once per step. ``targets``
    are shares of ``budget`` times all tokens.
    """
    n, d = F.col("n_tokens").cast("double"), len(domains)
    if not d:
        return _rate(budget, []), np.zeros(0), np.zeros(0)
    p = [F.col("posterior")[k] for k in range(d)]
    on = F.when(F.col("rate") > 0, n)
    products = [F.sum(on * p[i] * p[j]) for i in range(d) for j in range(i, d)]
    total = float(members.agg(F.sum(n)).first()[0] or 0)
    target = np.array([targets.get(k, 0.0) for k in domains]) * budget * total
    taken: list[np.ndarray] = []
    before, count = np.inf, 0
    while True:
        rated = members.withColumn("rate", _rate(budget, taken))
        sums = rated.agg(*[F.sum(F.col("rate") * n * x) for x in p], *products).first()
        expected, gram = np.split(np.array([float(x or 0) for x in sums]), [d])
        residual = np.abs(expected - target).sum()
        if residual <= tolerance * max(total, 1) or count == steps:
            return _rate(budget, taken), expected, target
        count += 1
        if residual > before:  # too long a step: half of it
            taken[-1] = taken[-1] / 2
            continue
        before = residual
        metric = np.zeros((d, d))
        metric[np.triu_indices(d)] = gram
        metric += np.triu(metric, 1).T
        ridge = 1e-9 * max(np.trace(metric), 1.0)
        taken.append(np.linalg.solve(metric + ridge * np.eye(d), expected - target))


def mix_documents(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain: str = "domain",
    text: str = "text", budget: float = 1.0, keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, ``n_tokens``, ``posterior``, ``rate``, ``copies`` and ``residual`` of every document.

    ``residual`` is the same in all rows: by domain, the expected tokens of the mix minus those asked for, so a mix
    that could not be met shows, also for a domain that no labelled row has. ``copies`` rounds the rate up or down by a hash of the kept columns, so that the expected number
    of copies is the rate, and a retry gives the same.
    """
    model = learn_domains(labelled, domain, text)
    docs = without(docs, "n_tokens", "posterior", "rate", "copies", "residual")
    keep = tuple(c for c in keep if c in docs.columns)
    members = shared(posteriors(docs, model, *keep, text=text), "members")
    rate, expected, target = fit_rates(members, model.domains, targets, budget)
    unmet = dict(zip(model.domains, (expected - target).tolist(), strict=True))
    if unknown := sorted(set(targets) - set(model.domains)):
        total = float(members.agg(F.sum("n_tokens")).first()[0] or 0)
        unmet |= {k: -targets[k] * budget * total for k in unknown}
    pairs = sorted((str(k), float(v)) for k, v in unmet.items())
    residual = F.array(*[F.struct(F.lit(k).alias("domain"), F.lit(v).alias("tokens")) for k, v in pairs])
    chance = F.pmod(F.xxhash64(*keep, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    out = members.withColumn("rate", rate)
    copies = F.floor(F.col("rate") + chance).cast("bigint")
    return out.withColumn("copies", copies).withColumn("residual", residual.cast("array<struct<domain:string,tokens:double>>"))
