"""What listings say about age, attendance and collection windows, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clock import MONTHS
from .location import address_place
from .text import DISTRICTS, fold, identity_text
from .venues import GENERIC

#: (pattern on folded text, least age: a group or a number, greatest age: a group or 120).  Fixed values.
AGE_RULES = (
    (r"\b(?:yas (?:siniri|araligi|grubu)|age (?:limit|range|restriction)|ages?)\s*[:：-]?\s*(\d{1,3})\s*[-–]\s*(\d{1,3})(?:\s*(?:yas|years?))?\b", "g1", "g2"),
    (r"\b(?:yas (?:siniri|araligi|grubu)|age (?:limit|restriction)|ages?)\s*[:：-]?\s*(\d{1,3})\s*(?:\+|ve uzeri|and (?:over|up)|or older)", "g1", 120),
    (r"(?<!\d)\+?(\d{1,3})\s*\+?\s*yas siniri(?: vardir| bulunmaktadir)?\b", "g1", 120),
    (r"\b(\d{1,3})\s*[-–]\s*(\d{1,3})\s*yas(?:\s+arasi)?\s+(?:cocuk(?:lar|lara)?|izleyici(?:ler|lere)?|katilimci(?:lar|lara)?)\s+(?:icin(?:dir)?|yonelik(?:tir)?|uygun(?:dur)?|onerilir|katilabilir)", "g1", "g2"),
    (r"\b(\d{1,3})\s*(?:yas\s*(?:ve uzeri|ustu)|\+)\s+(?:(?:olan|tum)\s+)?(?:(?:cocuk(?:lar|lara)?|izleyici(?:ler|lere)?|katilimci(?:lar|lara)?)\s+(?:icin(?:dir)?|yonelik(?:tir)?|uygun(?:dur)?|onerilir|katilabilir)|icin uygundur)", "g1", 120),
    (r"\b(?:suitable|recommended|intended) for\s+(?:children\s+)?(?:aged?\s+)?(\d{1,3})\s*(?:\+|and (?:over|up)|or older)", "g1", 120),
    (r"(?:^|[.!?;\n]\s*|\bage (?:limit|policy|restriction):?\s*|\b(?:suitable|recommended|open) (?:for|to)\s+)all ages\b", 0, 120),
    (r"\b(?:her yas(?:tan izleyicilere)?(?: icin)? uygundur|yas siniri (?:yoktur|yok|bulunmamaktadir))\b", 0, 120),
    (r"\b(?:adults? only|yetiskinlere ozel|18 yas ve uzeri)\b", 18, 120),
)
#: What before or after a rule takes it back.  Fixed values.
NOT_BEFORE = r"(?:\b(?:not|no|without)\s+|\bnot\s+(?:suitable|recommended)\s+for\s*)$"
NOT_AFTER = r"\b(?:(?:(?:uygun|gecerli) )?degil(?:dir)?|uygun olmayan|onerilmez|giremez|kabul edilmez|does not apply|not (?:suitable|allowed))\b"
BEFORE, AFTER, OLDEST = 24, 60, 120


def age_rules(description: Column) -> Column:
    """Array of (low, high, denied): every rule that a text states, whole, with what stands around it read for a denial."""
    words = fold(F.coalesce(description, F.lit("")))

    def of(pattern: str, low, high) -> Column:
        hits, gaps = F.regexp_extract_all(words, F.lit(pattern), F.lit(0)), F.split(words, pattern, -1)
        number = lambda g, i: F.get(F.regexp_extract_all(words, F.lit(pattern), F.lit(int(g[1]))), i).cast("int") if isinstance(g, str) else F.lit(g)

        def rule(hit: Column, i: Column) -> Column:
            back = F.concat(F.coalesce(F.get(hits, i - 1), F.lit("")), F.get(gaps, i))
            before = F.substring(back, F.greatest(F.length(back) - BEFORE + 1, F.lit(1)), F.lit(BEFORE))
            ahead = F.concat(F.get(gaps, i + 1), F.coalesce(F.get(hits, i + 1), F.lit("")))
            after = F.substring(F.get(F.split(ahead, r"[.!?;\n]"), F.lit(0)), 1, AFTER)
            return F.struct(number(low, i).alias("low"), number(high, i).alias("high"), (before.rlike(NOT_BEFORE) | after.rlike(NOT_AFTER)).alias("denied"))

        return F.transform(hits, rule)

    found = F.concat(*(of(*r) for r in AGE_RULES))
    return F.filter(found, lambda r: r["denied"] | ((r["low"] <= r["high"]) & (r["high"] <= OLDEST)))


def age_status(rules: Column, years: Column) -> Column:
    """supported, contradicted or unknown for an age: a denial or rules that disagree leave it unknown."""
    fits = F.filter(rules, lambda r: (years >= r["low"]) & (years <= r["high"]))
    return (
        F.when((F.size(rules) == 0) | F.exists(rules, lambda r: r["denied"]), "unknown").when(F.size(fits) == F.size(rules), "supported")
        .when(F.size(fits) > 0, "unknown").otherwise("contradicted")
    )


#: Hours that a schedule may be open ahead.  Fixed value.
LONGEST_WINDOW = 60


def schedule_gate(event: Column, enabled: Column, until: Column, now: Column) -> Column:
    """Struct of run and reason: whether a collection may start for an event, a switch and a deadline as written."""
    stated = until.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$")
    at = F.when(stated, F.try_to_timestamp(until))
    ahead = (F.unix_micros(at) - F.unix_micros(now)) / 3.6e9
    cases = (
        (event == "workflow_dispatch", True, "manual"), (~event.eqNullSafe(F.lit("schedule")), False, "unsupported_event"), (~enabled.eqNullSafe(F.lit("true")), False, "disabled"),
        (until == "open", True, "open_schedule"), (~F.coalesce(stated, F.lit(False)) | at.isNull(), False, "invalid_deadline"), (ahead <= 0, False, "expired"),
        (ahead > LONGEST_WINDOW, False, "window_exceeds_60h"),
    )
    answer = lambda run, reason: F.struct(F.lit(run).alias("run"), F.lit(reason).alias("reason"))
    return reduce(lambda out, c: out.when(c[0], answer(*c[1:])), cases[1:], F.when(cases[0][0], answer(*cases[0][1:]))).otherwise(answer(True, "scheduled_window"))


def attendance_timing(category: Column, description: Column, flexible: Column, first: Column, last: Column, starts: Column, zone: str = "Europe/Istanbul") -> Column:
    """admission_window, timed_session or unknown, and null where nothing is claimed: a flexible listing with a window; a museum or
    exhibition with several starts on a day, whose text names sessions and being late."""
    local = F.transform(starts, lambda t: F.struct(F.to_date(F.from_utc_timestamp(t, zone)).alias("day"), F.date_format(F.from_utc_timestamp(t, zone), "HH:mm").alias("clock")))
    distinct = F.array_distinct(F.filter(local, lambda x: x["day"].isNotNull()))
    several = F.size(distinct) > F.size(F.array_distinct(F.transform(distinct, lambda x: x["day"])))
    said = F.coalesce(description, F.lit(""))
    session = said.rlike(r"(?iU)\bseans(?:lar|ı|in|iniz| saati| saatinden)?\b") & said.rlike(r"(?iu)ge[çc]\s*kal")
    return (
        F.when(flexible & (first <= last), "admission_window").when(flexible, "unknown").when(~category.isin("Müze", "Sergi"), None)
        .when(several & session, "timed_session").otherwise("unknown")
    )


#: Support that a candidate needs, and what a distribution and its score may be off.  Fixed values.
LEAST_SUPPORT, SUM_SLACK, SCORE_SLACK, SUPPORT_SLACK = 0.7, 0.02, 0.05, 1e-9


def distribution_fault(p: Column, score: Column, support: Column) -> Column:
    """What is wrong with a grade's distribution over 0 to 3, its score and its support; null if nothing is."""
    each = F.size(p) == 4
    valid = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    expected = F.get(p, 1) + 2 * F.get(p, 2) + 3 * F.get(p, 3)
    return (
        F.when(~F.coalesce(each, F.lit(False)) | ~F.coalesce(valid, F.lit(False)), "probabilities").when(F.abs(total - 1) > SUM_SLACK, "sum")
        .when(score.isNull() | F.isnan(score) | (score < 0) | (score > 3), "score").when(F.abs(score - expected) > SCORE_SLACK, "score_contradicts_probabilities")
        .when(support.isNull() | F.isnan(support) | (support > 1) | (F.abs(support - (F.get(p, 2) + F.get(p, 3))) > SUPPORT_SLACK), "support")
    )


#: What a listing's own text says of its format, on folded words.  Fixed values.
PERFORMANCE = r"\b(?:tiyatro oyunu|stand up gosterisi|canli konser)\b"
WORKSHOP = r"\b(?:atolye(?:si|de|den|ye|nin|miz(?:de)?)?|workshop)\b"
TAKING_PART = r"\b(?:katilimci|katilimcilar|egitmen|ogren|uretir|uretecek|yapacak|tasarla|uygulama|malzeme|kontenjan|kayit)\w*\b"
TALK, COURSE = r"\b(?:soylesi(?:si|de)?|panel(?:ist(?:ler)?)?|moderator|seminer)\b", r"\b(?:kurs|egitim programi)\b"
GUIDE = r"\b(?:uzman|profesyonel) rehber\w*\b|\bguided (?:tour|visit|walk)\b"
STOPS = (
    r"\b(?:kiliseler\w*|yapilar\w*|mekanlar\w*|duraklar\w*|churches|sites|venues)\b.{0,80}\b(?:ziyaret|visit)\w*\b"
    r"|\b(?:ziyaret edilecek|visiting)\b.{0,80}\b(?:kiliseler\w*|yapilar\w*|mekanlar\w*|duraklar\w*|churches|sites|venues)\b"
)
ITINERARY = r"\b(?:program|tur) boyunca\b|\b(?:ozel aracla ulasim|meeting point)\b"
TITLE_FORMATS = (
    (r"\b(?:konser(?:i)?|concert)\b", "Konser"), (r"\b(?:tiyatro oyunu|cocuk oyunu|muzikal(?:i)?|theatre play|theater play)\b", "Tiyatro"), (r"\b(?:stand up|standup)\b", "Stand-up"),
    (None, None), (r"\b(?:atolye(?:si|leri)?|workshop)\b", "Workshop"), (r"\b(?:soylesi(?:si)?|seminer|konferans)\b", "Söyleşi"),
)
#: How far into a description its opening and its programme reach, and what stands around a workshop.  Fixed values.
OPENING, OPENING_WORDS, PROGRAMME, AROUND = 512, 240, 4096, (80, 120)


def program_format(title: Column, description: Column) -> Column:
    """The category that a listing's own title and programme state, or null: what its opening names first, ahead of a performance;
    then a stand-up show, a guided tour of several stops, and what the title says."""
    said = F.coalesce(description, F.lit(""))
    name, opening = identity_text(title), F.substring(identity_text(F.substring(said, 1, OPENING)), 1, OPENING_WORDS)
    programme = identity_text(F.substring(said, 1, PROGRAMME))
    at = lambda p: F.regexp_instr(opening, F.lit(p))
    show, shop = at(PERFORMANCE), at(WORKSHOP)
    size = F.length(F.regexp_extract(opening, WORKSHOP, 0))
    from_ = F.greatest(shop - AROUND[0], F.lit(1))
    shop = F.when(F.substring(opening, from_, shop + size + AROUND[1] - from_).rlike(TAKING_PART), shop).otherwise(0)
    first = F.filter(F.array(*(F.struct(i.alias("at"), F.lit(n).alias("turn"), F.lit(c).alias("is")) for n, (i, c) in enumerate(((shop, "Workshop"), (at(TALK), "Söyleşi"), (at(COURSE), "Eğitim"))))), lambda x: (x["at"] > 0) & ((show == 0) | (x["at"] < show)))
    out = F.when(F.size(first) > 0, F.array_min(first)["is"])
    out = out.when((name != "") & (F.startswith(opening, F.concat(name, F.lit(" stand up gosterisi"))) | F.startswith(opening, F.concat(name, F.lit(" stand up show")))), "Stand-up")
    out = out.when(programme.rlike(GUIDE) & programme.rlike(STOPS) & programme.rlike(ITINERARY), "Gezi")
    for pattern, category in TITLE_FORMATS:
        out = out.when(name.rlike(pattern), category) if pattern else out.when(show > 0, None)
    return out


#: Claims about children that are taken back, and those that stand.  Fixed values.
NO_CHILDREN = r"\b(?:cocuk(?:lar|lara|larin)?|children|kids?)\b[^.!?\n]{0,36}\b(?:degil(?:dir)?|degildir|icermez|yok|not|isn't|is not)\b"
CHILDREN = (
    r"\b(?:cocuk(?:lar|lara|larin)?\s+(?:icin|oyunu|tiyatrosu|muzikali|sirki|stand[ -]?up)|cocuklara\s+yonelik|(?:children|kids?)['’s]*\s+(?:show|theatre|theater|musical|circus|comedy)|(?:show|theatre|theater|musical|circus|comedy)\s+for\s+(?:children|kids?))\b",
    r"\b\d{1,2}\s*[–-]\s*\d{1,2}\s*yas\b[^.!?\n]{0,40}\bcocuk(?:lar|lara|larin)?\b",
    r"\bcocuk(?:lar|lara|larin)?\b[^.!?\n]{0,32}\b(?:aileleri|aileler)\b[^.!?\n]{0,16}\bicin\b",
    r"\b(?:merhaba\s+cocuklar|(?:cocuklar|minik\s+(?:seyirciler|izleyiciler))[^.!?\n]{0,64}(?:davet|bekliyor|bulusuyor|katil))\b",
)


def child_audience(title: Column, description: Column) -> Column:
    """Whether a listing is said to be for children, after clauses that take it back."""
    bare = lambda c: F.regexp_replace(fold(F.coalesce(c, F.lit(""))), NO_CHILDREN, " ")
    text = F.concat_ws(" ", bare(title), bare(description))
    return reduce(lambda a, p: a | text.rlike(p), CHILDREN[1:], text.rlike(CHILDREN[0]))


def in_district(district: Column, address: Column, venue: Column, asked: str) -> Column:
    """Whether a listing lies in a district: its own label, unless the address names another; without a label the address, and
    without both the venue's name."""
    label, want = F.trim(fold(F.coalesce(district, F.lit("")))), asked
    known, place = label.isin(DISTRICTS), address_place(address, DISTRICTS)
    veto = known & F.coalesce(place != label, F.lit(False))
    named = fold(F.coalesce(venue, F.lit(""))).rlike(rf"\b{want}\b")
    return ~veto & ((label == want) | (~known & F.when(place.isNotNull(), place == want).otherwise(named)))


#: Words of venue names that conflict patterns pass over, and what stands between a date and a venue.  Fixed values.
WEEKDAY = r"(?:(?:pazartesi|sali|carsamba|persembe|cuma|cumartesi|pazar)\s+)?"
KIND = r"(?:\s+(?:konseri|gosterisi|oyunu|muzikali|etkinligi|programi))?"
SOLD_OUT = r"(?:\s+(?:ta|te|da|de))?\s+gerceklesecek\s+istanbul\s+konserinin\s+biletleri(?:\s+kisa\s+surede)?\s+tukendi\b"


def day_month(start: Column, zone: str = "Europe/Istanbul") -> Column:
    """Day and folded month name of an instant, as texts write it."""
    local = F.from_utc_timestamp(start, zone)
    return F.concat_ws(" ", F.dayofmonth(local), identity_text(F.get(F.array(*map(F.lit, MONTHS)), F.month(local) - 1)))


def venue_conflict(title: Column, description: Column, start: Column, venue: Column, city: Column) -> Column:
    """Whether a listing's own programme sentence puts its title on its date at another venue."""
    name, said, date = identity_text(title), identity_text(description), day_month(start)
    pattern = F.concat(F.lit(r"\b"), name, F.lit(rf"\b{KIND}\s+"), date, F.lit(rf"\s+{WEEKDAY}gunu\s+([a-z0-9]+(?:\s+[a-z0-9]+){{0,11}}?)\s*(?:nda|nde)\b"))
    stated = F.call_function("regexp_extract", said, pattern, F.lit(1))
    words = lambda c: F.filter(F.split(c, " "), lambda t: (F.length(t) > 1) & ~t.isin([*GENERIC, "sahnesi", "sanat", "tiyatrosu"]))
    own, other = words(identity_text(venue)), words(stated)
    return F.coalesce((identity_text(city) == "istanbul") & (name != "") & (stated != "") & (F.size(own) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(own, other), F.lit(False))


def sold_out_conflict(title: Column, description: Column, start: Column, venue: Column, city: Column, availability: Column) -> Column:
    """Whether a listing on sale says of its own date and venue that the concert is sold out."""
    name, said, place = identity_text(title), identity_text(description), identity_text(venue)
    pattern = F.concat(F.lit(r"\b"), day_month(start), F.lit(r"\b(?:\s+(?:de|da))?\s+"), place, F.lit(SOLD_OUT))
    return F.coalesce((availability == "available") & (identity_text(city) == "istanbul") & (name != "") & (place != "") & F.contains(said, name) & F.regexp_like(said, pattern), F.lit(False))
