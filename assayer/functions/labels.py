"""Labels, targets, prices and logits as Column expressions."""

from pyspark.sql import Column, functions as F

from assayer import fixed_values as V


def label_index(kind: Column, value: Column) -> Column:
    """Position of a label in its vocabulary; unknown labels are null."""
    v = F.lower(F.trim(value))
    prom = F.array_position(F.array(*[F.lit(x) for x in V.PROMINENCE_LABELS]), v) - 1
    sent = F.array_position(F.array(*[F.lit(x) for x in V.SENTIMENT_LABELS]), v) - 1
    flag = F.when(v == "true", 1).when(v == "false", 0)
    idx = F.when(kind == "prominence", prom).when(kind == "sentiment", sent).otherwise(flag)
    return F.when(idx >= 0, idx).cast("int")


def kind_width(kind: Column) -> Column:
    return F.when(kind == "prominence", 3).when(kind == "sentiment", 4).otherwise(2)


def one_hot(label: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def usage_cost(input_tokens: Column) -> Column:
    return input_tokens / 1e6 * V.CAND_INPUT_PER_MTOK


def token_cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / 1e6 * V.BASE_INPUT_PER_MTOK + output_tokens / 1e6 * V.BASE_OUTPUT_PER_MTOK


def argmax(logits: Column) -> Column:
    """First position of the largest value."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def log_sum_exp(logits: Column, t=1.0) -> Column:
    m = F.array_max(logits) / t
    return m + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x / t - m)))


def cross_entropy(logits: Column, label: Column, t=1.0) -> Column:
    """Loss against a one-hot target at a temperature, shifted by the maximum so that exp() cannot overflow."""
    return log_sum_exp(logits, t) - F.get(logits, label) / t


def softmax(logits: Column, t=1.0) -> Column:
    lse = log_sum_exp(logits, t)
    return F.transform(logits, lambda x: F.exp(x / t - lse))


def rounded(x: Column, digits: int) -> Column:
    """Half-up on the scaled value; round() itself looks at the printed digits, which other engines do not."""
    return F.round(x * float(10 ** digits), 0) / float(10 ** digits)


def pct(part: Column, whole: Column, digits: int = 1, empty=None) -> Column:
    ratio = rounded(F.try_divide(part * 100.0, whole), digits)
    return ratio if empty is None else F.coalesce(ratio, F.lit(empty))


def last_wins(items: Column, *keys: str) -> Column:
    """Of array items with equal key only the last stays.  Arrays here are bounded by one config."""
    def same(a, b):
        out = F.lit(True)
        for k in keys:
            out = out & a[k].eqNullSafe(b[k])
        return out

    tail = F.greatest(F.size(items), F.lit(1))
    return F.filter(items, lambda x, i: ~F.exists(F.slice(items, i + 2, tail), lambda y: same(x, y)))
