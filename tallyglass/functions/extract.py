"""Fields found in plain text. Every function takes Columns of text and gives a Column, null where nothing is found.

`text` is the text as it came; `numbers` is textnorm.for_numbers of its NFC form.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.functions.columns import all_found, any_in, as_count, bound, cut_before, empty_to_null, first_where, found, matches, one_of, pattern, strings, stripped, without
from tallyglass.functions.similarity import label_rows, ratio
from tallyglass.functions.textnorm import confusable_key, hangul_joined

GPS_TYPE = "struct<latitude:double,longitude:double>"


@bound
def two_digits(t: Column) -> Column:
    return F.when(F.char_length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)


@bound
def month_date(t: Column) -> Column:
    """Year, three-letter month and day."""
    months = F.create_map(*[F.lit(x) for m in V.MONTHS.items() for x in m])
    month = F.try_element_at(months, F.initcap(F.lower(found(t, V.DATE_MONTH, 2))))
    return F.when(month.isNotNull(), F.concat_ws("-", found(t, V.DATE_MONTH, 1), month, two_digits(found(t, V.DATE_MONTH, 3))))


def _dated(t: Column, p: str, century: bool) -> Column:
    """The parts of a match are read from the match, not from the whole text again."""
    return _date_of(found(t, p), p, century)


@bound
def _date_of(m: Column, p: str, century: bool) -> Column:
    return F.when(m.isNotNull(), F.concat_ws("-", _year(found(m, p, 1), century), two_digits(found(m, p, 2)), two_digits(found(m, p, 3))))


@bound
def _year(y: Column, century: bool) -> Column:
    return F.when(F.char_length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y) if century else y


def numeric_date(t: Column) -> Column:
    """Year of two to four digits, month and day, not validated."""
    return _dated(t, V.DATE_NUMERIC, True)


def single_dots(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit(".."), F.lit(".")), F.lit("..."), F.lit("."))


def no_dot_runs(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit(".."), F.lit("")), F.lit("..."), F.lit(""))


@bound
def date(text: Column, numbers: Column) -> Column:
    """`numbers` must come from single_dots(text)."""
    dots = single_dots(text)
    return F.coalesce(month_date(dots), numeric_date(dots), _dated(numbers, V.DATE_NOISY, False))


def bare_date(numbers: Column) -> Column:
    """A date of this century by its digits alone, months and days as they stand."""
    return F.translate(found(numbers, V.DATE_BARE), "./", "--")


@bound
def vehicle(text: Column, numbers: Column) -> Column:
    """The first plate form that occurs, else a plate mended from misread digits."""
    plates = [without(found(text, p), " ") for p in V.PLATES]
    tail = found(numbers, V.PLATE_NOISY, 3)
    mended = F.when(tail.rlike(r"^\d{4}$"), F.concat(found(numbers, V.PLATE_NOISY, 1), found(numbers, V.PLATE_NOISY, 2), tail))
    return F.coalesce(*plates, mended)


def bare_plate(numbers: Column) -> Column:
    """The first four digits that stand alone and are no year."""
    return first_where(all_found(numbers, V.PLATE_BARE), lambda x: ~F.startswith(x, F.lit("202")))


def plate_cleaned(t: Column) -> Column:
    return stripped(F.regexp_replace(t, pattern(V.PLATE_PREFIX), ""))


@bound
def _place(lat: Column, lon: Column) -> Column:
    ok = lat.between(*V.LATITUDES) & lon.between(*V.LONGITUDES)
    return F.when(ok, F.struct(lat.alias("latitude"), lon.alias("longitude")))


@bound
def gps(numbers: Column) -> Column:
    """A pair of coordinates, one with commas for points, or the first latitude and longitude among all decimals."""
    def pair(p: str, comma: bool) -> Column:
        parts = [found(numbers, p, k) for k in (1, 2)]
        return _place(*[(F.translate(x, ",", ".") if comma else x).try_cast("double") for x in parts])

    every = F.transform(all_found(numbers, V.GPS_ANY, 1), lambda x: x.try_cast("double"))
    lat = first_where(every, lambda x: x.between(*V.LATITUDES))
    lon = first_where(every, lambda x: x.between(*V.LONGITUDES))
    loose = F.when(F.size(every) >= 2, _place(lat, lon))
    return F.coalesce(pair(V.GPS_PAIR, False), pair(V.GPS_LOOSE, True), loose)


@bound
def phone(text: Column) -> Column:
    """The first number that is no mobile's, else the first."""
    return _best_phone(F.transform(all_found(text, V.PHONE), lambda m: F.struct(*[F.regexp_extract(m, pattern(V.PHONE), k).alias(f"p{k}") for k in (1, 2, 3)])))


@bound
def _best_phone(parts: Column) -> Column:
    best = F.coalesce(first_where(parts, lambda x: x["p1"] != "010"), F.get(parts, F.lit(0)))
    return F.when(F.size(parts) > 0, F.concat_ws("-", best["p1"], best["p2"], best["p3"]))


@bound
def address(text: Column) -> Column:
    """From a region's name to what follows an address, regions in order."""
    tries = []
    for region in V.REGIONS:
        a = stripped(found(text, f"({region}" + V.ADDRESS_TAIL, 1, ignore_case=True))
        tries.append(F.when(F.contains(text, F.lit(region)) & (F.char_length(a) > 5), a))
    return F.coalesce(*tries)


@bound
def valid_company(core: Column, full: Column) -> Column:
    low = without(F.lower(full), " ")
    return (F.char_length(core) >= 2) & ~any_in(without(full, " "), V.COMPANY_BLACKLIST) & ~any_in(low, V.UNIT_NOISE) & (F.char_length(full) <= 20)


@bound
def _last_words(t: Column) -> Column:
    """The last three words of a text of more than three."""
    parts = F.split(stripped(t), pattern(r"\s+"))
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, -3, 3), " ")).otherwise(t)


@bound
def _cut_at(t: Column, stop: str) -> Column:
    return F.when(F.contains(t, F.lit(stop)), stripped(F.substring_index(t, stop, 1))).otherwise(t)


@bound
def _prefixed(core: Column) -> Column:
    return F.struct(core.alias("core"), without(F.concat(F.lit("(주)"), core), " ").alias("full"))


@bound
def company(text: Column) -> Column:
    """By label, else before an honorific, else by the sign of a corporation after or before the name."""
    t = no_dot_runs(text)
    return _company(t, without(stripped(cut_before(stripped(found(t, V.COMPANY_LABELLED, 2)), V.COMPANY_STOPS)), " "))


@bound
def _company(t: Column, labelled: Column) -> Column:
    polite_text = F.when(F.contains(t, F.lit("귀하")), t).otherwise("")
    polite = stripped(found(polite_text, V.COMPANY_HONORIFIC, 1))
    several = F.size(F.split(polite, pattern(r"\s+"))) > 3
    polite_value = F.when(several, _last_words(polite)).when(~F.contains(polite, F.lit("보관용")), empty_to_null(polite))
    # The sign is looked for first: without it the patterns would try every run of letters from each of its starts.
    signed = F.when(F.contains(t, F.lit("(주)")), t).otherwise("")
    after = F.transform(all_found(signed, V.CORP_AFTER, 1), lambda x: _last_words(stripped(x)))
    after = F.transform(after, lambda x: F.struct(x.alias("core"), F.concat(x, F.lit("(주)")).alias("full")))
    after = first_where(after, lambda x: valid_company(x["core"], x["full"]))

    def named(x: Column) -> Column:
        return _prefixed(reduce(_cut_at, V.PREFIX_STOPS, stripped(x)))

    before = F.transform(all_found(signed, V.CORP_BEFORE, 1), named)
    before = first_where(before, lambda x: ~matches(x["core"], r"^[\d\s-]+$") & valid_company(x["core"], x["full"]))
    return F.when(F.char_length(labelled) >= 2, labelled).when(matches(polite_text, V.COMPANY_HONORIFIC), polite_value).otherwise(F.coalesce(after["full"], before["full"]))


@bound
def issuer(text: Column, company_: Column) -> Column:
    """The first corporation of a line that is valid and not the company."""
    lines = F.filter(F.split(no_dot_runs(text), "\n"), lambda x: F.contains(x, F.lit("(주)")))
    names = F.flatten(F.transform(lines, lambda x: F.concat(all_found(x, V.ISSUER_BEFORE, 1), all_found(x, V.ISSUER_AFTER, 1))))
    stops = [s.replace(" ", "") for s in V.ISSUER_STOPS]

    def kept(x: Column) -> Column:
        bare = without(x, " ")
        core = F.replace(bare, F.lit("(주)"), F.lit(""))
        clean = (bare != "(주)") & ~matches(core, r"^[\d\.-]+$") & ~any_in(F.upper(bare), stops)
        other = (without(F.coalesce(company_, F.lit("")), " ") == "") | (bare != without(F.coalesce(company_, F.lit("")), " "))
        return clean & other & (F.char_length(x) >= 2) & valid_company(stripped(F.replace(x, F.lit("(주)"), F.lit(""))), x)

    return first_where(F.transform(names, stripped), kept)


@bound
def ticket_id(text: Column, numbers: Column, vehicle_: Column) -> Column:
    """The best-scored value after a slip label, the first among equals; else a short number after a date."""
    plate = without(vehicle_, " ")
    p = pattern(V.TICKET, ignore_case=True)

    def rated(m: Column, i: Column) -> Column:
        label = F.upper(without(F.regexp_extract(m, p, 1), " ."))
        return _rated(F.translate(stripped(F.regexp_extract(m, p, 2)), "oOB", "008"), any_in(label, V.TICKET_WORDS), plate, i)

    best = F.array_max(F.transform(all_found(text, V.TICKET, ignore_case=True), rated))["value"]
    return F.coalesce(best, _late_ticket(found(numbers, V.TICKET_AFTER_DATE, 1), plate))


@bound
def _rated(value: Column, named: Column, plate: Column, i: Column) -> Column:
    """The score of a value after a slip label; null if it is none."""
    bare = without(value, " ")
    same = F.coalesce((F.upper(plate) == F.upper(bare)) | (confusable_key(F.upper(plate)) == confusable_key(F.upper(bare))), F.lit(False))
    part = F.coalesce(F.contains(plate, bare), F.lit(False))
    ok = ~F.upper(value).isin(*V.LABEL_TOKENS) & ~same & ~(part & ((F.char_length(value) <= 2) | ~named)) & ~(matches(value, r"^\d{1,4}$") & ~named)
    score = F.when(named, 10).otherwise(0) + F.when(F.char_length(value) >= 5, 5).otherwise(0) + F.when(F.contains(value, F.lit("-")), 5).otherwise(0)
    return F.when(ok, F.struct(score.alias("score"), (-i).alias("first"), value.alias("value")))


@bound
def _late_ticket(late: Column, plate: Column) -> Column:
    taken = F.coalesce((F.upper(late) == F.upper(plate)) | (F.contains(F.upper(plate), F.upper(late)) & (F.char_length(late) >= 3)), F.lit(False))
    return F.when(matches(late, r"^\d+$") & (as_count(late) < 10_000) & ~taken, late)


@bound
def product(text: Column) -> Column:
    value = stripped(found(text, V.PRODUCT, 2))
    return F.when(~any_in(without(value, " "), V.PRODUCT_STOPS), empty_to_null(hangul_joined(value)))


@bound
def kind(text: Column) -> Column:
    """In or out, by label, else if just one of the two is named."""
    said = without(stripped(found(text, V.TYPE_LABELLED, 2)), " ")
    into, out = matches(text, V.TYPE_IN), matches(text, V.TYPE_OUT)
    return F.when(F.contains(said, F.lit("입고")), "입고").when(F.contains(said, F.lit("출고")), "출고").when(into & ~out, "입고").when(out & ~into, "출고")


def product_cleaned(t: Column) -> Column:
    """Cut at each label of a next field, in turn, whose letters may be spaced out."""
    return stripped(hangul_joined(_cut_at_next(t)))


@bound
def _cut_at_next(t: Column) -> Column:
    """Most texts hold no letter that such a label begins with, and are left as they are."""
    return F.when(matches(t, one_of(x[0] for x in V.NEXT_LABELS)), reduce(_cut_at_spaced, V.NEXT_LABELS, t)).otherwise(t)


@bound
def _cut_at_spaced(t: Column, label: str) -> Column:
    p = r"\s*".join(label)
    return F.when(matches(t, p), stripped(F.regexp_replace(t, pattern(f"(?s){p}.*$"), ""))).otherwise(t)


@bound
def valid_product(t: Column) -> Column:
    clean = F.lower(without(t, ", "))
    dated = matches(t, r"\d{4}-\d{2}-\d{2}|\d{4}\.\d{2}\.\d{2}")
    return ~(matches(t, r"\d{1,2}시|\d{1,2}:\d{2}") | dated | matches(clean, r"^\d+(\.\d+)?(kg|ton|g|t)?$")) & (F.char_length(clean) >= 2)


@bound
def label_noise(t: Column) -> Column:
    """Whether a value is itself a label, or one with a letter more."""
    clean = without(t, " :.")
    return F.exists(strings(V.TRAILING_LABELS), lambda k: (clean == k) | (F.startswith(clean, k) & (F.char_length(clean) <= F.char_length(k) + 1)))


def trailing_vocabulary() -> list[str]:
    """Labels that may follow a value, longer ones first; equal lengths by their letters, so that ties have one result."""
    out = set(V.TRAILING_LABELS)
    for name, (labels, keywords) in V.LABELS.items():
        if name not in ("company", "issuer", "vehicle"):
            out |= {*labels, *keywords}
    return sorted((x for x in out if len(x) >= 2), key=lambda x: (-len(x), x))


def _resembles(t: Column, n: int):
    """Whether a text's last n letters resemble a label of about as many, with the same first letter."""
    end, first = F.substring(t, -n, n), F.substring(t, -n, 1)

    def like(r: Column) -> Column:
        return (F.abs(r["n"] - n) <= 1) & (F.substring(r["label"], 1, 1) == first) & (ratio(end, r) > F.when(r["n"] == 2, 49.0).otherwise(60.0))

    return like


@bound
def trailing_label_cut(t: Column) -> Column:
    """Without a label behind the value: the longest that occurs after its start, else one that the last two to four letters
    resemble."""
    words = trailing_vocabulary()
    inside = F.when(matches(t, "(?s)." + one_of(x[0] for x in words)), first_where(strings(words), lambda k: F.instr(t, k) > 1))
    rows = label_rows(words, fold=False)
    out = t
    for n in (4, 3, 2):
        like = F.substring(t, -n, 1).isin(*sorted({x[0] for x in words if abs(len(x) - n) <= 1})) & F.exists(rows, _resembles(t, n))
        out = F.when((F.char_length(t) >= n) & like, stripped(F.substring(t, F.lit(1), F.char_length(t) - n))).otherwise(out)
    return F.when(inside.isNotNull(), stripped(F.substring(t, F.lit(1), F.instr(t, inside) - 1))).otherwise(out)
