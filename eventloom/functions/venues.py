"""Names of venues: the words that tell a venue apart, its place, and titles that repeat its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .location import ASIAN
from .text import DISTRICTS, identity_text

#: Words of venue names that name no venue.  Fixed values.
GENERIC = "acik hava arena etkinlik gosteri istanbul kultur merkezi mekan performans salon salonu sahne tiyatro yer".split()
#: Building, hall and address words that come and go.  Fixed values.
DESCRIPTIVE = [*GENERIC, *"acikhava amfi auditorium avm cad caddesi ile km ksm merkez oditoryum oditoryumu sahnesi sanat sk sokak sokagi tiyatrosu ve".split()]
#: Words that never tell a venue apart alone.  Fixed values.
WEAK = "alt ana art arts bar buyuk cafe center centre city club hall house kafe kucuk kulup live of park pub stage studio studyo the theater theatre ust".split()
#: Neighbourhoods that lie in one district.  Fixed values.
NEIGHBOURHOODS = {
    "ayazaga": "sariyer",
    "bahariye": "kadikoy",
    "bomonti": "sisli",
    "bostanci": "kadikoy",
    "caddebostan": "kadikoy",
    "cihangir": "beyoglu",
    "emirgan": "sariyer",
    "galata": "beyoglu",
    "harbiye": "sisli",
    "karakoy": "beyoglu",
    "kosuyolu": "kadikoy",
    "kozyatagi": "kadikoy",
    "kustepe": "sisli",
    "maslak": "sariyer",
    "mecidiyekoy": "sisli",
    "moda": "kadikoy",
    "nisantasi": "sisli",
    "ortakoy": "besiktas",
    "sishane": "beyoglu",
    "sultanahmet": "fatih",
    "taksim": "beyoglu",
    "yenibosna": "bahcelievler",
}
TOKEN_DISTRICT = {d: d for d in DISTRICTS} | NEIGHBOURHOODS


def place_tokens(text: Column) -> Column:
    """Folded words, with the district of two words as one."""
    return F.split(F.trim(F.replace(F.concat(F.lit(" "), identity_text(text), F.lit(" ")), F.lit(" eyup sultan "), F.lit(" eyupsultan "))), " ")


def token_district(token: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in TOKEN_DISTRICT.items() for x in pair)), token)


def name_tokens(name: Column) -> Column:
    """Words of two letters or more that aren't generic."""
    return F.filter(F.split(identity_text(name), " "), lambda t: (F.length(t) > 1) & ~t.isin(GENERIC))


def distinctive_tokens(name: Column) -> Column:
    """The words that tell a venue apart: initials that stand alone are joined, descriptors go, and so do places
    unless only words that are never enough would be left."""
    joined = F.regexp_replace(F.array_join(place_tokens(name), " "), r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")
    tokens = F.filter(F.split(joined, " "), lambda t: (F.length(t) > 1) & ~t.isin(DESCRIPTIVE))
    # a variable of transform is worked out once, however often it stands in the expression
    pick = lambda own, named: F.when(F.exists(named, lambda t: ~t.isin(WEAK)), named).otherwise(own)
    both = F.transform(F.array(tokens), lambda own: F.struct(own.alias("own"), F.filter(own, lambda t: token_district(t).isNull()).alias("named")))
    return F.get(F.transform(both, lambda b: pick(b["own"], b["named"])), 0)


def identifying(token: Column) -> Column:
    return (F.length(token) >= 3) & ~token.isin(WEAK)


def name_districts(*texts: Column) -> Column:
    """The districts that the words of some texts name, sorted."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.flatten(F.array(*map(place_tokens, texts))), token_district))))


def side(district: Column) -> Column:
    return F.when(district.isin(ASIAN), "asia").when(district.isNotNull(), "europe")


def without_venue_prefix(title: Column, name: Column) -> Column:
    """A title without a leading copy of its venue's name ("Name x Act", "Name: Act"); other prefixes stay."""
    pattern = r"(?i)^(.+?)(?:[\x20\x09-\x0D]+(?:x|sunar|presents)[\x20\x09-\x0D]+|[\x20\x09-\x0D]*:[\x20\x09-\x0D]+)(.+)$"
    bare = F.trim(title)
    prefix, rest = F.split(identity_text(F.regexp_extract(bare, pattern, 1)), " "), F.regexp_extract(bare, pattern, 2)
    venue = distinctive_tokens(name)
    same = (F.array_join(prefix, "") == F.array_join(venue, "")) | F.forall(prefix, lambda t: F.array_contains(venue, t))
    return F.when((F.size(venue) > 0) & (identity_text(rest) != "") & F.exists(prefix, identifying) & same, rest).otherwise(title)
