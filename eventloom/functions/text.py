"""Text normalisation as column expressions: folding, keys, tokens, cleaning."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no search meaning.  Fixed values.
STOP_WORDS = (
    "bir biraz icin olsun bana gore olan var neler ne bu ve ile etkinlik istiyorum plan daha tl lira hafta sonu"
).split()
#: Districts that addresses are matched with.  Fixed values.
DISTRICTS = (
    "adalar arnavutkoy atasehir avcilar bagcilar bahcelievler bakirkoy basaksehir bayrampasa besiktas beykoz "
    "beylikduzu beyoglu buyukcekmece catalca cekmekoy esenler esenyurt eyupsultan fatih gaziosmanpasa gungoren "
    "kadikoy kagithane kartal kucukcekmece maltepe pendik sancaktepe sariyer silivri sultanbeyli sultangazi sile "
    "sisli tuzla umraniye uskudar zeytinburnu"
).split()
#: (pattern on folded text, category): the first that fits is the provider's category.  Fixed values.
SOURCE_CATEGORIES = (
    (r"(?:stand up|standup)", "Stand-up"),
    (r"(?:atolye\w*|workshop\w*)", "Workshop"),
    (r"(?:tiyatro|theatre|theater|musical|muzikal)", "Tiyatro"),
    (r"(?:sinema|film|cinema)", "Sinema"),
    (r"(?:sergi|exhibition)", "Sergi"),
    (r"(?:muze|museum)", "Müze"),
    (r"(?:spor|sport|sports|basketbol|basketball|futbol|football|tenis|voleybol)", "Spor"),
    (r"(?:soylesi|seminer|konferans|panel|talk|conference)", "Söyleşi"),
    (r"(?:egitim|mebonayliegitim|kurs|education|course)", "Eğitim"),
    (r"(?:konser|muzik|music|pop|rock|jazz|caz|klasik|rap|hiphop|party)", "Konser"),
    (r"(?:festival)", "Festival"),
    (r"(?:bale|dans|dance)", "Dans"),
    (r"(?:opera|gosteri|sirk|show|circus|sahne sanatlari)", "Gösteri"),
    (r"(?:gezi|tur|tour)", "Gezi"),
)


def _fold_map() -> tuple[str, str]:
    """Every Latin letter up to U+024F that isn't plain lower case, and what it folds to: Turkish lower
    case, without marks.  Made by rule; letters that fold to themselves are left out."""
    source, target = [], []
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x250)]:
        c = chr(code)
        low = {"I": "i", "İ": "i", "ı": "i"}.get(c, c.lower())
        bare = "".join(x for x in unicodedata.normalize("NFD", low) if not unicodedata.combining(x))
        bare = bare.replace("ı", "i")
        if len(bare) == 1 and bare != c:
            source.append(c)
            target.append(bare)
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_map()


def fold(text: Column) -> Column:
    """Lower case by Turkish rules, without marks, one character for one: offsets stay valid for
    composed text; loose combining marks are dropped."""
    return F.translate(F.regexp_replace(text, "[̀-ͯ]", ""), FOLD_FROM, FOLD_TO)


def identity_text(text: Column) -> Column:
    """Folded words of letters and digits, one space apart; null counts as empty."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def compact_key(text: Column) -> Column:
    return F.replace(identity_text(text), F.lit(" "), F.lit(""))


def search_tokens(text: Column) -> Column:
    """Folded words of three letters or more that aren't stop words; repeats are kept."""
    words = F.split(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))


def document_text(title: Column, category: Column, venue: Column, description: Column) -> Column:
    """Labelled fields on a line each, as many as 10 000 characters."""
    parts = (("Title", title), ("Category", category), ("Venue", venue), ("Description", description))
    lines = [F.concat(F.lit(f"{name}: "), F.trim(F.coalesce(c, F.lit("")))) for name, c in parts]
    return F.substring(F.concat_ws("\n", *lines), 1, 10_000)


def clean_html(text: Column) -> Column:
    """Text without tags, with the five named entities and &nbsp; resolved and single spaces."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "[\\x20\\x09-\\x0D]+", " "))


def _word(text: Column, pattern: str) -> Column:
    """Whether folded text, with single spaces, holds the pattern as whole words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).rlike(f" {pattern} ")


def category_key(value: Column) -> Column:
    key = identity_text(value)
    return (
        F.when(_word(key, "(?:konser|muzik)"), "concert")
        .when(_word(key, "(?:tiyatro|oyun)"), "theatre")
        .when(_word(key, "(?:stand up|standup)"), "standup")
        .when(_word(key, "(?:atolye|workshop)"), "workshop")
        .otherwise(key)
    )


def title_key(title: Column, category: Column) -> Column:
    """Identity text of a title without the generic word that its category implies."""
    key, kind = identity_text(title), category_key(category)
    bare = (
        F.when(kind == "concert", F.regexp_replace(key, " +konseri?$", ""))
        .when(kind == "theatre", F.regexp_replace(key, " +(?:tiyatro +)?oyunu$", ""))
        .when(kind == "standup", F.regexp_replace(key, " +stand up$", ""))
        .otherwise(key)
    )
    return F.when(bare == "", key).otherwise(bare)


def source_category(label: Column) -> Column:
    """Category for a provider's label by the first pattern that fits, or null."""
    text = identity_text(label)
    return reduce(lambda out, x: out.when(_word(text, x[0]), x[1]), SOURCE_CATEGORIES[1:], F.when(_word(text, SOURCE_CATEGORIES[0][0]), SOURCE_CATEGORIES[0][1]))


def sentences(text: Column) -> Column:
    """Sentences: parts that end with . ! or ?, or at a line end; blanks are dropped."""
    ended = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[\x20\x09-\x0D]+", "$1\n")
    return F.filter(F.transform(F.split(ended, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def evidence_lines(text: Column, pattern: str) -> Column:
    """The first three sentences whose folded text fits a pattern, as many as 240 characters each."""
    hits = F.filter(sentences(text), lambda s: fold(s).rlike(pattern))
    return F.transform(F.slice(hits, 1, 3), lambda s: F.substring(s, 1, 240))


def identity_hash(namespace: str, *parts: Column) -> Column:
    """SHA-256 of a namespace and values, set apart by the unit separator; null values are empty."""
    return F.sha2(F.concat_ws("\x1f", F.lit(namespace), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
