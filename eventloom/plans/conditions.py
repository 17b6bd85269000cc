"""Conditions with three-valued evidence, compiled to one nullable boolean column.

True is supported, false contradicted and null unknown: Kleene logic is what AND, OR and NOT of a
nullable column do.  A hard plan keeps the rows whose column is true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location
from ..functions.clock import local_clock
from ..functions.text import fold
from ..functions.timing import doors_only


def unknown() -> Column:
    """Evidence that says nothing."""
    return F.lit(None).cast("boolean")



@dataclass(frozen=True)
class Atom:
    """One test.  kind names the evidence rule, args are its values."""

    kind: str
    args: tuple = ()


@dataclass(frozen=True)
class All:
    children: tuple = ()


@dataclass(frozen=True)
class Any:
    children: tuple = ()


@dataclass(frozen=True)
class Not:
    child: object = None


Evidence = Callable[..., Column]
#: Kinds for which no evidence under an odd number of negations means that the row lacks it.
CLOSED_WORLD = frozenset({"topic"})


def compile_condition(condition, evidence: dict[str, Evidence], negated: bool = False) -> Column:
    """The condition as a nullable boolean column.  An empty All is true; an empty Any is an error."""
    match condition:
        case Atom(kind, args):
            if kind not in evidence:
                raise ValueError(f"no evidence rule for {kind}")
            found = evidence[kind](*args)
            return F.coalesce(found, F.lit(False)) if negated and kind in CLOSED_WORLD else found
        case All(children):
            return reduce(lambda a, b: a & b, (compile_condition(c, evidence, negated) for c in children), F.lit(True))
        case Any(children):
            if not children:
                raise ValueError("an empty Any has no meaning")
            return reduce(lambda a, b: a | b, (compile_condition(c, evidence, negated) for c in children))
        case Not(child):
            return ~compile_condition(child, evidence, not negated)
    raise TypeError(f"not a condition: {condition!r}")


def status(found: Column) -> Column:
    return F.when(found, "supported").when(~found, "contradicted").otherwise("unknown")


def apply_plan(df: DataFrame, condition, evidence: dict[str, Evidence]) -> DataFrame:
    """Rows that support the condition."""
    return df.where(compile_condition(condition, evidence))


# Evidence rules for rows with the usual columns ------------------------------------------------


def category_evidence(column: str) -> Evidence:
    return lambda *wanted: F.col(column).isin(*wanted)


def budget_evidence(price: str, currency: Column | None = None, party: Column | None = None) -> Evidence:
    """(comparison, amount, basis): null for an unknown price, another currency, an approximate budget or, with the
    basis group_total, a party of unknown size."""

    def rule(comparison: str, amount: float, basis: str = "each") -> Column:
        if comparison == "approx" or (basis == "group_total" and party is None):
            return unknown()
        value = F.col(price) * party if basis == "group_total" else F.col(price)
        test = {"lt": value < amount, "lte": value <= amount, "gt": value > amount, "gte": value >= amount}[comparison]
        return test if currency is None else F.when(currency, test)

    return rule


def time_evidence(start: Column, description: Column, timed: Column | None = None) -> Evidence:
    """(from, to, after, before) as HH:mm on the local clock, each bound may be None; after and before leave
    the bound itself out.  Null where the stated time is that of the doors or the row has no timed session."""

    def rule(first: str | None = None, last: str | None = None, after: bool = False, before: bool = False) -> Column:
        at, ok = local_clock(start), F.lit(True)
        if first is not None:
            ok = ok & ((at > first) if after else (at >= first))
        if last is not None:
            ok = ok & ((at < last) if before else (at <= last))
        known = ~doors_only(description) if timed is None else ~doors_only(description) & F.coalesce(timed, F.lit(True))
        return F.when(known & at.isNotNull(), ok)

    return rule


def location_evidence(label: Column, address: Column, labelled: Column, place: Column) -> Evidence:
    """(precision, name): the provider's place first, then the labelled district.  A row in another city or online
    is no match; a neighbourhood stays unknown."""
    here = location.resolve_location(label, address)
    given = location.resolve_location(labelled, F.lit(None).cast("string"))
    elsewhere = F.coalesce(place.isin("other_city", "online"), F.lit(False))

    def rule(precision: str, name: str) -> Column:
        if precision == "neighborhood":
            found = unknown()
        elif precision == "side":
            wanted = location.resolve_location(F.lit(name), F.lit(None).cast("string"))
            found = F.coalesce(here["side"], given["side"]) == wanted["side"]
        else:
            found = F.coalesce(here["district"], given["district"]) == fold(F.lit(name))
        return F.when(elsewhere, F.lit(False)).otherwise(found)

    return rule


#: Folded words of open-air venues.  Fixed values.
OPEN_AIR = r"(?:^|[^a-z0-9_])(?:acik ?hava(?:da)?|open[- ]air|amfi ?tiyatro|amfi|amphitheat(?:re|er))(?:$|[^a-z0-9_])"
#: Probability from which a labelled format counts.  Fixed value.
LABEL_SUPPORT = 0.7


def experience_evidence(texts: Sequence[Column], checks: dict[str, Column], outdoor: Column, seated: Column) -> Evidence:
    """(value): outdoors by the words of venue, title and text, or by its label; seated by its check, or by its
    label; all else by the check of that name, unknown without one."""

    def rule(value: str) -> Column:
        if value == "outdoors":
            said = F.exists(F.array_compact(F.array(*texts)), lambda t: fold(t).rlike(OPEN_AIR))
            return F.when(said | (outdoor >= LABEL_SUPPORT), F.lit(True))
        check = checks[value] if value in checks else unknown()
        return F.coalesce(check, F.when(seated >= LABEL_SUPPORT, F.lit(True))) if value == "seated" else check

    return rule


@dataclass(frozen=True)
class Audience:
    """What is known of whom a row is for.  labelled: whether it has labels at all; kind: children, family, general
    or adult_only; suitable: probability that it suits children; family: the check on its text, nullable."""

    labelled: Column
    kind: Column
    min_age: Column
    max_age: Column
    suitable: Column
    family: Column


#: Ages and probabilities at which an audience takes children or doesn't.  Fixed values.
TEEN, CHILD, SUITABLE, UNSUITABLE = 13, 10, 0.65, 0.25


def child_evidence(a: Audience) -> Column:
    """Whether children fit: by labels in the order kind, stated age, probability; without labels only by the text."""
    return (
        F.when(~a.labelled, F.when(a.family, F.lit(True)))
        .when((a.kind == "adult_only") | (a.min_age >= TEEN), F.lit(False))
        .when(a.kind.isin("children", "family") | (a.min_age <= CHILD) | (a.suitable >= SUITABLE), F.lit(True))
        .when(a.suitable <= UNSUITABLE, F.lit(False))
    )


def companion_evidence(a: Audience) -> Evidence:
    """(who): children and family need a fitting row, any other company is context."""
    return lambda who: child_evidence(a) if who in ("children", "family") else F.lit(True)


def attendee_age_evidence(a: Audience, stated: Callable[[int], Column], mentions: Column) -> Evidence:
    """(years): labelled limits, then adults only, then what the text states (mentions: whether it states
    anything), then the labelled audience."""

    def rule(years: int) -> Column:
        limits = F.lit(years).between(F.coalesce(a.min_age, F.lit(0)), F.coalesce(a.max_age, F.lit(120)))
        adult = a.kind.isin("general", "family", "adult_only")
        rest = child_evidence(a) if years < TEEN else F.when(adult, F.lit(True))
        return (
            F.when(a.labelled & (a.min_age.isNotNull() | a.max_age.isNotNull()), limits)
            .when(a.labelled & (a.kind == "adult_only") & F.lit(years < 18), F.lit(False))
            .when(~a.labelled | mentions, stated(years))
            .otherwise(rest)
        )

    return rule


def context_evidence(*_) -> Column:
    """Size of the party: context, always met."""
    return F.lit(True)


def mood_evidence(*_) -> Column:
    """No row says what mood it fits."""
    return unknown()


def date_evidence(first: str, last: str | None = None) -> Evidence:
    """(from, to): whether a day lies in the range, or a span [first, last] overlaps it."""
    return lambda a, b: (F.col(last or first) >= a) & (F.col(first) <= b)


def topic_evidence(text: Column) -> Evidence:
    """(words...): true if folded text holds one as a whole word; never false by itself."""
    return lambda *words: F.when(F.concat(F.lit(" "), text, F.lit(" ")).rlike(" (?:" + "|".join(words) + ") "), F.lit(True))


def presence_evidence(positive: Column, negative: Column) -> Column:
    """True or false by one-sided evidence; conflicting or no evidence is unknown."""
    return F.when(positive & ~negative, F.lit(True)).when(negative & ~positive, F.lit(False))


def soft_signal(signals: Sequence[Column]) -> Column:
    """Mean of the preferences that say something, from -1 to 1; 0 if none does."""
    said = F.array_compact(F.array(*signals))
    mean = F.aggregate(said, F.lit(0.0), lambda s, x: s + x) / F.size(said)
    return F.when(F.size(said) == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)))


def budget_signal(price: Column, comparison: str, amount: float) -> Column:
    """How far a price meets a wanted budget, from -1 to 1; 0 where the price is unknown."""
    ratio = (price - amount) / amount
    over = -F.least(F.lit(1.0), 2 * ratio)
    said = {
        "lt": F.when(price < amount, 1.0).otherwise(over),
        "lte": F.when(ratio <= 0, 1.0).otherwise(over),
        "gt": F.when(price > amount, 1.0).otherwise(-0.5),
        "gte": F.when(ratio >= 0, 1.0).otherwise(-0.5),
        "approx": F.when(F.abs(ratio) <= 0.2, 1.0).otherwise(-F.least(F.lit(1.0), F.abs(ratio))),
    }[comparison]
    return F.when(price.isNull(), 0.0).otherwise(said)


def location_signal(side: Column, district: Column, wanted_side: str, wanted_district: str | None) -> Column:
    """1 at the wanted place, .25 on its side, -.5 on the other side, 0 where unknown."""
    here = F.lit(1.0) if wanted_district is None else F.when(district == wanted_district, 1.0).otherwise(0.25)
    return F.when(side.isNull(), 0.0).when(side != wanted_side, -0.5).otherwise(here)


def soft_score(rank: Column, signal: Column, strength: float = 0.25, k: int = 60) -> Column:
    """Rank score (rank from 0) with a bounded preference multiplier."""
    return (1 + strength * signal) / (k + rank + 1)
