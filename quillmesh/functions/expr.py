"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column, digits: int) -> Column:
    """Rounds ties to the even digit, as the recorded results do."""
    return F.bround(col, digits)


def order_key(seed: int | str, id_col: Column) -> Column:
    """A shuffled order that is a pure function of (seed, id)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), id_col.cast("string")))


def class_of_path(path: Column) -> Column:
    """Class of an image by its immediate parent folder; null where it is neither."""
    parent = F.lower(F.element_at(F.split(path, "/"), -2))
    return F.when(parent == "fire", "Fire").when(parent.isin("no_fire", "nofire"), "No_Fire")


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(jpe?g|png)$")


def argmax(values: Column) -> Column:
    """0-based position of the largest value, the first on ties."""
    return F.array_position(values, F.array_max(values)) - 1


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cross_entropy(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    spread = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.log(spread) + top - F.get(logits, label.cast("int"))


def mean_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def widen_channels(w: Column, known: int, channels: int) -> Column:
    """First ``known`` channels as they are, further ones filled with their mean."""
    head = F.slice(w, 1, known)
    return F.concat(head, F.array_repeat(mean_of(head), channels - known))


def widen_kernel(w: Column, known: int, channels: int, area: int = 1) -> Column:
    """A flat kernel (filter, channel, place) for more channels: the further ones are the mean of the known ones, place by place."""

    def wider(f: Column) -> Column:
        at = lambda p: F.aggregate(F.sequence(F.lit(0), F.lit(known - 1)), F.lit(0.0), lambda s, c: s + F.get(f, c * area + p)) / known
        extra = F.flatten(F.array_repeat(F.transform(F.sequence(F.lit(0), F.lit(area - 1)), at), channels - known))
        return F.concat(f, extra)

    size = known * area
    filters = F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / size).cast("int") - 1), lambda i: wider(F.slice(w, i * size + 1, F.lit(size))))
    return F.flatten(filters)


def seeded_uniform(seed: int | str, key: Column, bound: float) -> Column:
    """A number in [-bound, bound) that is a pure function of (seed, key)."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 31) - 1) * bound


def parent_layer(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def strategy_mu(strategy: Column) -> Column:
    """Proximal weight of a strategy name: the number after the last underscore, 0.01 without one, 0 for others."""
    tail = F.element_at(F.split(strategy, "_"), -1).try_cast("double")
    return F.when(strategy.startswith("fedprox"), F.coalesce(tail, F.lit(0.01))).otherwise(0.0)


def mu_of(strategy: str) -> float:
    """``strategy_mu`` of one name, on the driver."""
    try:
        return float(strategy.rsplit("_", 1)[-1]) if strategy.startswith("fedprox") else 0.0
    except ValueError:
        return 0.01


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)
