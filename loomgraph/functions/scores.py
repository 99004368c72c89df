"""Numeric expressions: coercion, fusion, limits, discounts, labels, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels by kind. Fixed values.
LABELS = {"direct_support": 1.0, "bridge": 0.7, "weak_support": 0.3}
#: Caps of selected triples where a record carries none, soft and hard. Fixed values.
CAPS = {"webqsp": (14, 34), "cwq": (14, 32)}
DEFAULT_CAPS = (40, 95)
#: Growth of the soft limit with the number of gold triples. Fixed values.
SOFT_GROWTH = {"webqsp": 1.25, "cwq": 1.2}


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(default))


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.cast("string").try_cast("int"), F.lit(default))


def fuse(p1: Column, logit2: Column, w1: float, w2: float) -> Column:
    return w1 * p1 + w2 * sigmoid(logit2)


def fuse_logits(logit1: Column, logit2: Column, scale: float = 1.0) -> Column:
    return sigmoid(logit1 + scale * logit2)


def position_discount(rank: Column) -> Column:
    return 1 / F.log2(F.greatest(rank, F.lit(1)) + 1.0)


def triple_limits(dataset: Column, gold: Column, cap_soft: Column, cap_hard: Column) -> tuple[Column, Column]:
    """Soft and hard limits of selected triples; hard is at least soft."""
    gold, cap_soft, cap_hard = (F.greatest(x, F.lit(n)) for x, n in ((gold, 0), (cap_soft, 1), (cap_hard, 1)))
    soft = cap_soft
    for name, growth in SOFT_GROWTH.items():
        soft = F.when(dataset == name, F.floor(F.least(F.greatest(growth * gold, F.lit(22.0)), cap_soft)).cast("int")).otherwise(soft)
    hard = F.when(dataset.isin(*SOFT_GROWTH), F.floor(F.least(F.greatest(1.8 * gold, F.lit(40.0)), cap_hard)).cast("int")).otherwise(cap_hard)
    return soft, F.greatest(hard, soft)


def resolved_caps(dataset: Column, cap_soft: Column, cap_hard: Column) -> tuple[Column, Column]:
    """A record's caps, or the dataset's where either is missing."""
    missing = cap_soft.isNull() | cap_hard.isNull()
    out = []
    for k, cap in enumerate((cap_soft, cap_hard)):
        own = F.lit(DEFAULT_CAPS[k])
        for name, caps in CAPS.items():
            own = F.when(dataset == name, F.lit(caps[k])).otherwise(own)
        out.append(F.when(missing, own).otherwise(cap))
    return out[0], out[1]


def soft_label(direct: Column, bridge: Column, weak: Column, shortest: Column, labels: dict[str, float] | None = None) -> Column:
    """Weak overrides bridge, bridge overrides direct; shortest paths fill what has no label."""
    labels = labels or LABELS
    return F.when(weak, labels["weak_support"]).when(bridge, labels["bridge"]).when(direct, labels["direct_support"]).when(shortest, 1.0).otherwise(0.0)


def log_share(count: Column, most: Column) -> Column:
    """log(1 + n) as a share of log(1 + max)."""
    return F.when(most > 0, F.ln(1.0 + count) / F.ln(1.0 + most)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def bce_with_logits(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    """Binary cross entropy of a logit, stable for large values."""
    weight = 1 + (F.lit(pos_weight) - 1) * y if not isinstance(pos_weight, Column) else 1 + (pos_weight - 1) * y
    return (1 - y) * x + weight * (F.ln(1 + F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def payload_key(*columns: str) -> Column:
    """sha256 of the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
