"""Value names, normalisations and scalar transforms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical value names with their columns, and the other spellings.
VALUE_COLUMNS = {
    "vdw": ("vdw",),
    "cl": ("coulomb",),
    "vdw+cl": ("vdw", "coulomb"),
    "dvdw": ("vdw_dif",),
    "dcl": ("coulomb_dif",),
    "dvdw+dcl": ("vdw_dif", "coulomb_dif"),
}
VALUE_ALIASES = {"coulomb": "cl", "vdw+coulomb": "vdw+cl", "dcoulomb": "dcl", "dvdw+dcoulomb": "dvdw+dcl"}
# Names of normalisations.
NORMALIZATIONS = ("none", "per_atom_pair", "per_member_sqrt", "per_member_product", "per_coarse_member_sqrt", "per_coarse_member_product")
COARSE_KINDS = ("low_res", "bundle")


def value_name(name: str) -> str:
    """The canonical name of a value."""
    n = name.strip().lower()
    n = VALUE_ALIASES.get(n, n)
    if n not in VALUE_COLUMNS:
        raise ValueError(f"unknown value {name!r}; known: {', '.join(VALUE_COLUMNS)}")
    return n


def normalization_name(name: str) -> str:
    n = name.strip().lower()
    n = "none" if n == "raw" else n
    if n not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {name!r}; known: {', '.join(NORMALIZATIONS)}")
    return n


def is_derivative(name: str) -> bool:
    return value_name(name).startswith("d")


def value_expr(name: str) -> Column:
    """The named value as a double; stored floats are widened before they are added."""
    columns = [F.col(c).cast("double") for c in VALUE_COLUMNS[value_name(name)]]
    return columns[0] if len(columns) == 1 else columns[0] + columns[1]


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite; never null."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def divided(value: Column, by: Column, otherwise: Column) -> Column:
    """value / by where by > 0, else ``otherwise``."""
    return F.when(by > 0, value / F.when(by > 0, by)).otherwise(otherwise)


def member_denominator(normalization: str, m1: Column, m2: Column, kind1: Column, kind2: Column, coarse: tuple[str, ...] = COARSE_KINDS) -> Column:
    """What a member normalisation divides by. Coarse ones count members of coarse kinds only."""
    n = normalization_name(normalization)
    if "coarse" in n:
        m1 = F.when(kind1.isin(*coarse), m1).otherwise(F.lit(1))
        m2 = F.when(kind2.isin(*coarse), m2).otherwise(F.lit(1))
    product = m1.cast("double") * m2.cast("double")
    return F.sqrt(product) if n.endswith("sqrt") else product


def normalized(value: Column, normalization: str, n_atom_pairs: Column, m1: Column, m2: Column, kind1: Column, kind2: Column, otherwise: Column) -> Column:
    """``value`` under a normalisation; ``otherwise`` where it would divide by 0 or less."""
    n = normalization_name(normalization)
    if n == "none":
        return value
    if n == "per_atom_pair":
        return divided(value, n_atom_pairs.cast("double"), otherwise)
    return divided(value, member_denominator(n, m1, m2, kind1, kind2), otherwise)


def graph_distance(value: Column, name: str) -> Column:
    """Length of an edge for shortest paths: the strength of a derivative, the inverse strength of an energy."""
    strength = F.abs(value)
    return strength if is_derivative(name) else F.when(strength > 0, F.lit(1.0) / F.when(strength > 0, strength))


def radius(value: Column, mode: str, scale: float) -> Column:
    """Drawn radius of an edge: linear, sqrt or log of the strength."""
    strength = F.abs(value)
    by = {"linear": strength, "sqrt": F.sqrt(strength), "log": F.log1p(strength)}
    if mode not in by:
        raise ValueError(f"unknown radius mode {mode!r}")
    return by[mode] * F.lit(float(scale))


ROOT = 0.4


def signed_root(value: Column, vmax: Column) -> Column:
    """Position of a value on a colour scale from 0 to 1 with 0.5 for 0: a signed root of its share of vmax."""
    return F.lit(0.5) + F.lit(0.5) * F.signum(value) * F.pow(F.abs(value) / vmax, F.lit(ROOT))


def signed_root_inverse(position: Column, vmax: Column) -> Column:
    t = (position - 0.5) * 2
    return F.signum(t) * F.pow(F.abs(t), F.lit(1 / ROOT)) * vmax
