"""Mendelian tables from the rule of segregation: each parent passes one of its two alleles with probability 1/2.

Genotype states run from affected to free: AA, Aa, aa on an autosome (and XX, Xx, xx for females), XY, xY
for males.  A person of unknown sex has the female states and then the male ones.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.operators.factors import Model

FEMALE, MALE, UNKNOWN = 0, 1, 2
PATTERNS = ("AD", "AR", "XL")
#: States by group; autosomal models use group 0 for everybody.
STATES = {FEMALE: 3, MALE: 2, UNKNOWN: 5}


def passes_two(state: int) -> dict[int, float]:
    """Affected alleles (1 or 0) that a person with two copies passes on."""
    affected = (2 - state) / 2
    return {1: affected, 0: 1 - affected}


def female_child(mother: int, father_allele: dict[int, float]) -> list[float]:
    out = [0.0] * 3
    for (m, p), (f, q) in product(passes_two(mother).items(), father_allele.items()):
        out[2 - m - f] += p * q
    return out


def autosomal_cpt() -> list:
    return [[female_child(m, passes_two(f)) for f in range(3)] for m in range(3)]


def x_female_cpt() -> list:
    """A daughter has her father's only X."""
    return [[female_child(m, {1 - f: 1.0}) for f in range(2)] for m in range(3)]


def x_male_cpt() -> list:
    """A son's X is his mother's."""
    return [[[passes_two(m)[1], passes_two(m)[0]] for _ in range(2)] for m in range(3)]


def x_unknown_cpt() -> list:
    """Either sex with probability 1/2."""
    d, s = x_female_cpt(), x_male_cpt()
    return [[[x / 2 for x in (*d[m][f], *s[m][f])] for f in range(2)] for m in range(3)]


def emission(pattern: str, group: int = FEMALE, no_diagnosis: float = 0.0) -> list[list[float]]:
    """[state][not affected, affected]: dominant shows with one allele, recessive with two, or a male's only one."""
    shows = {"AD": [True, True, False], "AR": [True, False, False], "XL": {FEMALE: [True, False, False], MALE: [True, False], UNKNOWN: [True, False, False, True, False]}}[pattern]
    shows = shows[group] if isinstance(shows, dict) else shows
    return [[no_diagnosis, 1 - no_diagnosis] if s else [1.0, 0.0] for s in shows]


def scaled(table, strength: float):
    return [scaled(t, strength) for t in table] if isinstance(table, list) else table * strength + 1


def priors(pattern: str, strength: float = 1.0, root_strength: float = 1.0) -> Model:
    """Dirichlet parameters: table times strength plus one; the free state of roots has its own strength."""
    root = lambda k: [1.0] * (k - 1) + [float(root_strength)]
    if pattern != "XL":
        return Model({0: root(3)}, {0: scaled(emission(pattern), strength)}, {(0, 0, 0): scaled(autosomal_cpt(), strength)})
    cpt = {(FEMALE, MALE, FEMALE): x_female_cpt(), (FEMALE, MALE, MALE): x_male_cpt(), (FEMALE, MALE, UNKNOWN): x_unknown_cpt()}
    unknown_root = [1.0, 1.0, float(root_strength), 1.0, float(root_strength)]
    return Model({FEMALE: root(3), MALE: root(2), UNKNOWN: unknown_root}, {g: scaled(emission("XL", g), strength) for g in STATES}, {k: scaled(t, strength) for k, t in cpt.items()})


def means(alpha: Model) -> Model:
    """Expected parameters under Dirichlet rows."""
    from stemma.operators.learning import each, normal

    return each(alpha, normal)


def evidence(pattern: Column, group: Column, affected: Column, carrier: Column, is_root: Column, shaded_root: Column) -> Column:
    """array<int> of allowed states, null for all: diagnosis, then carrier flag, then roots (the later rule wins).

    With an affected root in the graph, the roots that are not affected are free.
    """
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    xl = pattern == "XL"
    male, unknown = xl & (group == MALE), xl & (group == UNKNOWN)
    free = F.when(male, arr(1)).when(unknown, arr(2, 4)).otherwise(arr(2))
    sick = F.when(pattern == "AD", arr(1)).when(unknown, arr(0, 3)).otherwise(arr(0))
    bears = F.when(male, arr(0)).otherwise(arr(1))
    return F.when(is_root & shaded_root & ~affected, free).when(carrier, bears).when(affected, sick)


def carrier_probability(sex: Column, p: Column, pattern: Column) -> Column:
    """From smoothed state probabilities (an array) to the chance of passing the allele on."""
    xl = pattern == "XL"
    two = (2 * F.get(p, F.lit(0)) + F.get(p, F.lit(1))) / 2
    return F.when(xl & (sex == "male"), F.get(p, F.lit(0))).when(xl & (sex == "unknown"), (2 * F.get(p, F.lit(0)) + F.get(p, F.lit(1)) + F.get(p, F.lit(3))) / 3).otherwise(two)
