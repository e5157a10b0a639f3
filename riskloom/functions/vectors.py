"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12  # fixed value: keeps norms away from zero
HASH_DIM = 128  # fixed value: length of the hash embedding


def hash_embed(text: Column, dim: int = HASH_DIM) -> Column:
    """SHA-256 of the text, doubled up with digests of all bytes so far, as unit vector of byte/255."""
    data = F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))
    have = 32
    while have < dim:
        data = F.concat(data, F.unhex(F.sha2(data, 256)))
        have += 32
    # Read as Latin-1, each byte is one character with the byte's value as its code.
    letters = F.slice(F.split(F.decode(data, "ISO-8859-1"), ""), 1, dim)
    return unit(F.transform(letters, lambda c: F.ascii(c) / F.lit(255.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v / (|v| + epsilon), with v and its norm computed once."""
    scaled = F.transform(F.array(F.struct(v.alias("v"))), lambda s: F.struct(s["v"].alias("v"), (norm(s["v"]) + EPSILON).alias("n")))
    return F.element_at(F.transform(scaled, lambda s: F.transform(s["v"], lambda x: x / s["n"])), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * (norm(b) + EPSILON) + EPSILON)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x)
