"""Score-row expressions: top-1/top-k, multi-hot, softmax/sigmoid, losses (M-1..M-5, M-9..M-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._compat import col_of


def argmax(scores) -> Column:
    """M-1: index of the largest score, the first on ties (0-based)."""
    s = col_of(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def one_hot(idx, n: int) -> Column:
    """M-1 one-hot form."""
    idx = col_of(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == idx).cast("int"))


def topk_indices(scores, k: int) -> Column:
    """M-2: indices of the ``k`` largest scores, best first, ties to the lower index."""
    s = col_of(scores)
    pairs = F.transform(s, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"].cast("int"))


def multi_hot_from_indices(idx_list, n: int) -> Column:
    """M-2 multi-hot form."""
    lst = col_of(idx_list)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(lst, i).cast("int"))


def names_of(indices, vocab: Sequence[str]) -> Column:
    """F-13 / M-3: index list -> names through a fixed vocabulary (top-k names in score order)."""
    voc = F.array(*[F.lit(v) for v in vocab])
    return F.transform(col_of(indices), lambda i: F.element_at(voc, i + 1))


def multi_hot(labels, vocab: Sequence[str]) -> Column:
    """M-5: label list -> 0/1 vector in vocabulary order."""
    lab = col_of(labels)
    return F.array(*[F.coalesce(F.array_contains(lab, F.lit(v)), F.lit(False)).cast("int") for v in vocab])


def multi_hot_inverse(bits, vocab: Sequence[str]) -> Column:
    """M-5 inverse: 0/1 vector -> label names."""
    voc = F.array(*[F.lit(v) for v in vocab])
    b = col_of(bits)
    return F.filter(voc, lambda v, i: F.element_at(b, i + 1) == 1)


def softmax(scores) -> Column:
    """M-11: numerically stable softmax."""
    s = col_of(scores)
    m = F.array_max(s)
    ex = F.transform(s, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0).cast("double"), lambda a, x: a + x)
    return F.transform(ex, lambda x: x / tot)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col_of(x)))


def sigmoid_all(scores) -> Column:
    return F.transform(col_of(scores), lambda x: sigmoid(x))


def binary_accuracy(y_true, y_prob, threshold: float = 0.5) -> Column:
    """M-9: per row, the share of positions where ``(p > threshold) == y``."""
    y, p = col_of(y_true), col_of(y_prob)
    eq = F.zip_with(y, p, lambda a, b: ((b > threshold).cast("int") == a.cast("int")).cast("double"))
    return F.aggregate(eq, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(eq)


def categorical_crossentropy(y_onehot, probs, eps: float = 1e-7) -> Column:
    """M-10: ``-sum(y * ln(clip(p)))`` per row."""
    terms = F.zip_with(col_of(y_onehot), col_of(probs), lambda y, p: y.cast("double") * F.log(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))))
    return -F.aggregate(terms, F.lit(0.0).cast("double"), lambda a, x: a + x)


def weighted_binary_crossentropy(y_true, probs, pos_weight: float = 4.0, eps: float = 1e-7) -> Column:
    """M-10: binary cross-entropy with positives weighted, summed over positions."""

    def term(y, p):
        pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
        y = y.cast("double")
        return -(F.lit(pos_weight) * y * F.log(pc) + (1 - y) * F.log(1 - pc))

    return F.aggregate(F.zip_with(col_of(y_true), col_of(probs), term), F.lit(0.0).cast("double"), lambda a, x: a + x)


def bce_with_logits(y_true, logits) -> Column:
    """M-10: stable ``max(x,0) - x*y + log1p(exp(-|x|))``, mean over positions."""
    t = F.zip_with(col_of(y_true), col_of(logits), lambda y, x: F.greatest(x, F.lit(0.0)) - x * y.cast("double") + F.log1p(F.exp(-F.abs(x))))
    return F.aggregate(t, F.lit(0.0).cast("double"), lambda a, x: a + x) / F.size(t)


def crossentropy_index(label_idx, logits) -> Column:
    """M-10 (label-index form): ``logsumexp(x) - x[label]``."""
    x = col_of(logits)
    m = F.array_max(x)
    lse = m + F.log(F.aggregate(x, F.lit(0.0).cast("double"), lambda a, v: a + F.exp(v - m)))
    return lse - F.element_at(x, col_of(label_idx) + 1)
