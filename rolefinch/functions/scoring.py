"""Components of a posting's score. A null component is undefined and takes no part in the total."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, folded


@dataclass(frozen=True)
class Weights:
    skill_coverage: float = 0.50
    title_match: float = 0.25
    recency: float = 0.15
    location_fit: float = 0.10

    def __post_init__(self):
        if any(not 0 <= w <= 1 for w in self.values()):
            raise ValueError("weights lie between 0 and 1")

    def values(self):
        return (self.skill_coverage, self.title_match, self.recency, self.location_fit)


@dataclass(frozen=True)
class Profile:
    skills: list[str] = field(default_factory=list)
    target_titles: list[str] = field(default_factory=list)
    exclude_titles: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    remote_only: bool = False
    text: str = ""


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; a bit of a number for each letter of ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for ch in b:
        hit = row & at.get(ch, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


_BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")


def words_of(text: str | None) -> frozenset[str]:
    return frozenset(x for x in _BETWEEN.split((text or "").lower()) if x)


def token_set_ratio(ta: frozenset[str], tb: frozenset[str]) -> float:
    """Similarity 0 to 100 of two sets of words: the shared words against each remainder."""
    if not ta or not tb:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(x)) for x in (ta & tb, ta - tb, tb - ta))
    s, la, lb = len(both), len(only_a), len(only_b)
    if s and not (la and lb):
        return 100.0
    sep = 1 if s else 0
    best = 100 - 100 * (la + lb - 2 * common_subsequence(only_a, only_b)) / (2 * (s + sep) + la + lb)
    if s:
        best = max(best, 100 - 100 * (sep + la) / (s + s + sep + la), 100 - 100 * (sep + lb) / (s + s + sep + lb))
    return best


def title_match(title: Column, targets: list[str]) -> Column:
    """The best similarity, 0 to 1, of a title and a target; null without targets. Equal titles of a batch are compared once."""
    if not targets:
        return F.lit(None).cast("double")
    wanted = [words_of(t) for t in targets]

    def match(titles: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(titles, use_na_sentinel=False)
        best = [max(token_set_ratio(words_of(t if isinstance(t, str) else None), w) for w in wanted) / 100 for t in distinct]
        return pd.Series(best, dtype="float64").take(codes).reset_index(drop=True)

    return F.pandas_udf(match, "double")(title)


def skill_coverage(posting: Column, profile: list[str]) -> Column:
    own = _array(profile)
    return F.when((F.size(posting) > 0) & F.lit(bool(profile)), covered(posting, profile) / F.size(posting))


def covered(posting: Column, profile: list[str]) -> Column:
    return F.size(F.array_intersect(posting, _array(profile)))


def age_days(posted_at: Column, now: Column) -> Column:
    return F.greatest(F.timestamp_diff("MICROSECOND", posted_at, now) / F.lit(8.64e10), F.lit(0.0))


def recency(posted_at: Column, now: Column, half_life_days: float = 14.0) -> Column:
    if half_life_days <= 0:
        raise ValueError("the half-life is positive")
    return F.exp(-F.log(F.lit(2.0)) * age_days(posted_at, now) / half_life_days)


def location_fit(locations: Column, remote_policy: Column, profile: Profile) -> Column:
    """1 for a wanted place (either text holding the other), 0.5 for remote, else 0; null without preferences."""
    if profile.remote_only:
        return F.when(remote_policy == "remote", 1.0).otherwise(0.0)
    if not profile.locations:
        return F.lit(None).cast("double")
    wanted = _array([folded(x) for x in profile.locations])
    fits = F.exists(F.transform(locations, casefold), lambda p: F.exists(wanted, lambda w: F.contains(p, w) | F.contains(w, p)))
    return F.when(F.coalesce(fits, F.lit(False)), 1.0).when(remote_policy == "remote", 0.5).otherwise(0.0)


def total(components: list[Column], weights: Weights) -> Column:
    """The weighted mean of the defined components; 0 if there is none."""
    up = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in zip(components, weights.values(), strict=True)), F.lit(0.0))
    down = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(components, weights.values(), strict=True)), F.lit(0.0))
    return F.when(down > 0, up / down).otherwise(0.0)


def vetoed(title: Column, profile: Profile) -> Column:
    if not profile.exclude_titles:
        return F.lit(False)
    unwanted = _array([folded(x) for x in profile.exclude_titles])
    return F.coalesce(F.exists(F.transform(F.array(title), casefold), lambda t: F.exists(unwanted, lambda x: F.contains(t, x))), F.lit(False))


def passes(title: Column, fit: Column, profile: Profile, hard_location: bool = False) -> Column:
    """Not vetoed and, where location is a hard filter, not a mismatch; an undefined fit passes."""
    return ~vetoed(title, profile) & (~fit.eqNullSafe(F.lit(0.0)) if hard_location else F.lit(True))


def why(coverage: Column, n_covered: Column, n_skills: Column, match: Column, posted_at: Column, now: Column) -> Column:
    parts = F.array(F.when(coverage.isNotNull(), F.format_string("covers %d/%d skills", n_covered, n_skills)), F.when(match >= 0.8, "title"), F.when(posted_at.isNotNull(), F.concat(F.floor(age_days(posted_at, now)).cast("string"), F.lit("d"))))
    text = F.array_join(F.array_compact(parts), " · ")
    return F.when(text == "", "no ranking signals").otherwise(text)


def details(coverage: Column, n_covered: Column, n_skills: Column, match: Column, recent: Column, fit: Column, half_life_days: float = 14.0) -> list[Column]:
    """A line for each component that says what it stands for, or why it is undefined."""
    either = lambda c, yes, no: F.when(c.isNotNull(), F.lit(yes)).otherwise(F.lit(no))
    return [
        F.when(coverage.isNotNull(), F.format_string("covers %d/%d skills", n_covered, n_skills)).when(n_skills > 0, "no recognized skills in your profile").otherwise("no recognized skills in this posting"),
        either(match, "best fuzzy match over target titles", "no target titles set"),
        either(recent, f"exp decay, half-life {half_life_days:g}d", "posting date unknown"),
        either(fit, "exact / remote-OK / mismatch -> 1 / 0.5 / 0", "no location preferences set"),
    ]
