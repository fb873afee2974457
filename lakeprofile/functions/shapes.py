"""What a value looks like: shapes of text by patterns and checksums, kinds of binary by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CERTAIN, NEAR = 0.95, 0.50
COUNTRIES = "AD AE AF AG AI AL AM AO AR AT AU AZ BA BB BD BE BF BG BH BI BJ BN BO BR BS BT BW BY BZ CA CD CF CG CH CI CL CM CN CO CR CU CV CY CZ DE DJ DK DM DO DZ EC EE EG ER ES ET FI FJ FM FR GA GB GD GE GH GM GN GQ GR GT GW GY HK HN HR HT HU ID IE IL IN IQ IR IS IT JM JO JP KE KG KH KI KM KN KP KR KW KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MG MH MK ML MM MN MO MR MT MU MV MW MX MY MZ NA NE NG NI NL NO NP NR NZ OM PA PE PG PH PK PL PT PW PY QA RO RS RU RW SA SB SC SD SE SG SI SK SL SM SN SO SR SS ST SV SY SZ TD TG TH TJ TL TM TN TO TR TT TV TW TZ UA UG US UY UZ VA VC VE VN VU WS YE ZA ZM ZW".split()
CURRENCIES = "AED AFN ALL AMD ARS AUD AZN BAM BDT BGN BHD BND BOB BRL BYN CAD CHF CLP CNY COP CRC CZK DKK DOP DZD EGP EUR GBP GEL GHS HKD HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KRW KWD KZT LBP LKR MAD MDL MXN MYR NGN NOK NPR NZD OMR PEN PHP PKR PLN PYG QAR RON RSD RUB SAR SEK SGD THB TND TRY TWD UAH USD UYU UZS VND XAF XOF ZAR".split()

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Shapes that a pattern alone decides, in order of priority.  Both engines read these patterns alike.
PATTERNS: dict[str, str] = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "url": r"^(https?|ftp)://[^ /?#]+[^ ]*$",
    "urn": r"^urn:[a-z0-9][a-z0-9-]{1,31}:[^ ]+$",
    "content_type": r"^(application|audio|font|image|message|model|multipart|text|video)/[A-Za-z0-9][A-Za-z0-9.+-]*(; ?[a-z-]+=[^ ;]+)*$",
    "ip": rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$|^([0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$|^(([0-9a-fA-F]{{1,4}}:){{0,6}}[0-9a-fA-F]{{1,4}})?::(([0-9a-fA-F]{{1,4}}:){{0,6}}[0-9a-fA-F]{{1,4}})?$",
    "mac_address": r"^[0-9a-fA-F]{2}(:[0-9a-fA-F]{2}){5}$|^[0-9a-fA-F]{2}(-[0-9a-fA-F]{2}){5}$",
    "country_code": "^(" + "|".join(COUNTRIES) + ")$",
    "currency_code": "^(" + "|".join(CURRENCIES) + ")$",
    "postal_code": r"^[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}$|^[0-9]{5}-[0-9]{4}$|^[A-Z][0-9][A-Z] [0-9][A-Z][0-9]$|^[0-9]{4} [A-Z]{2}$",
    "bic": r"^[A-Z]{4}(" + "|".join(COUNTRIES) + r")[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "phone": r"^\+[1-9][0-9 ().-]{6,18}[0-9]$|^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$",
    "timezone": r"^(Africa|America|Antarctica|Asia|Atlantic|Australia|Europe|Indian|Pacific)/[A-Z][A-Za-z_+-]+(/[A-Z][A-Za-z_-]+)?$|^Etc/[A-Za-z0-9+-]+$",
    "jwt": r"^eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$",
    "json": r"^[{\[]",
    "hex": r"^[0-9a-f]{16,}$|^[0-9A-F]{16,}$",
    "base64": r"^[A-Za-z0-9+/]{18,}={1,2}$",
    "latlon": r"^-?([1-8]?[0-9](\.[0-9]+)|90(\.0+)), ?-?(1[0-7][0-9]|[1-9]?[0-9])(\.[0-9]+)$",
    "iso8601_duration": r"^P([0-9]+[YMWD])+(T([0-9]+(\.[0-9]+)?[HMS])+)?$|^PT([0-9]+(\.[0-9]+)?[HMS])+$",
    "iso8601_date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "iso8601_datetime": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$",
    "numeric_string": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$",
    "semver": r"^v?(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$",
    "path": r"^(/|\./|\.\./|~/)[^ ]*[^ /]$|^[A-Za-z]:\\[^ ]+$",
    "filename": r"^[A-Za-z0-9_-][A-Za-z0-9_. -]*\.[A-Za-z][A-Za-z0-9]{0,4}$",
    "prose": r"^[^ ]+( [^ ]+){4}",
}
BINARY = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "pdf": "25504446", "gzip": "1F8B", "zip": "504B0304"}
#: What else a text of a shape must have: a number is no hex string.
ALSO = {"hex": "[a-fA-F]"}
#: What a pattern can't say, in Spark and in SQL: whole groups of four, a document that parses.
BEYOND = {
    "base64": (lambda c: F.length(c) % 4 == 0, "length({c}) % 4 = 0"),
    "json": (lambda c: F.try_parse_json(c).isNotNull(), "json_valid({c})"),
    "jwt": (lambda c: F.coalesce(F.try_parse_json(_segment(c)).isNotNull(), F.lit(False)), "true"),
}
#: Where each shape with a checksum stands among the patterns: before the named one.
CHECKED_BEFORE = {"isbn": "bic", "ean": "bic", "imei": "bic", "card_number": "bic", "iban": "bic", "vin": "base64"}


def _segment(c: Column) -> Column:
    """The text of a token's first part, which is Base64 in the alphabet of URLs; null if it is none."""
    part = F.translate(F.substring_index(c, ".", 1), "-_", "+/")
    whole = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.try_to_binary(whole, F.lit("base64")).cast("string")


def _digits(c: Column) -> Column:
    return F.transform(F.split(c, "(?<=.)(?=.)", -1), lambda d: d.cast("int"))


def _weighted(c: Column, weights: list[int]) -> Column:
    return F.aggregate(F.zip_with(_digits(c), F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def isbn(c: Column) -> Column:
    bare = F.regexp_replace(c, "[ -]", "")
    ten = _weighted(F.substring(bare, 1, 9), list(range(10, 1, -1))) + F.when(F.right(bare, F.lit(1)) == "X", 10).otherwise(F.right(bare, F.lit(1)).try_cast("int"))
    return F.when(bare.rlike("^[0-9]{9}[0-9X]$"), ten % 11 == 0).when(bare.rlike("^97[89][0-9]{10}$"), _weighted(bare, [1, 3] * 6 + [1]) % 10 == 0).otherwise(False)


def ean(c: Column) -> Column:
    padded = F.lpad(c, 14, "0")
    return F.when(c.rlike("^([0-9]{8}|[0-9]{12,14})$"), _weighted(padded, [3, 1] * 7) % 10 == 0).otherwise(False)


def iban(c: Column) -> Column:
    bare = F.regexp_replace(c, " ", "")
    moved = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    numbers = F.array_join(F.transform(F.split(moved, "(?<=.)(?=.)", -1), lambda x: F.when(x.rlike("[A-Z]"), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")
    rest = F.aggregate(_digits(numbers), F.lit(0), lambda a, d: (a * 10 + d) % 97)
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def vin(c: Column) -> Column:
    letters = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ", (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9)))
    values = F.translate(c, "".join(letters), "".join(map(str, letters.values())))
    total = _weighted(values, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])
    check = F.substring(c, 9, 1)
    return F.when(c.rlike("^[A-HJ-NPR-Z0-9]{17}$"), total % 11 == F.when(check == "X", 10).otherwise(check.try_cast("int"))).otherwise(False)


CHECKED = {
    "isbn": isbn,
    "ean": ean,
    "imei": lambda c: F.when(c.rlike("^[0-9]{15}$"), luhn(c)).otherwise(False),
    "card_number": lambda c: F.when(F.regexp_replace(c, "[ -]", "").rlike("^[3-6][0-9]{12,18}$"), luhn(F.regexp_replace(c, "[ -]", ""))).otherwise(False),
    "iban": iban,
    "vin": vin,
}


def _order() -> list[str]:
    names: list[str] = []
    for p in PATTERNS:
        names += [c for c, before in CHECKED_BEFORE.items() if before == p]
        names.append(p)
    return names


ORDER = _order()


def shape(c: Column, checked: bool = True) -> Column:
    """The first shape in ``ORDER`` that a text has, null if none."""

    def fits(n: str) -> Column:
        found = c.rlike(PATTERNS[n]) & c.rlike(ALSO[n]) if n in ALSO else c.rlike(PATTERNS[n])
        return found & BEYOND[n][0](c) if n in BEYOND else found

    tests = [F.when(fits(n), n) if n in PATTERNS else F.when(F.coalesce(CHECKED[n](c), F.lit(False)), n) for n in ORDER if checked or n in PATTERNS]
    return F.coalesce(*tests)


def shape_sql(c: str) -> str:
    """The pattern shapes of ``shape`` as a DuckDB expression."""
    quoted = lambda p: p.replace("'", "''")
    more = lambda n: (f" AND regexp_matches({c}, '{ALSO[n]}')" if n in ALSO else "") + (f" AND {BEYOND[n][1].format(c=c)}" if n in BEYOND else "")
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{quoted(p)}'){more(n)} THEN '{n}'" for n, p in PATTERNS.items()) + " END"


def binary_kind(c: Column) -> Column:
    head = F.hex(F.substring(c, 1, 8))
    return F.coalesce(*[F.when(head.startswith(magic), n) for n, magic in BINARY.items()])


def verdict(tally: dict[str, int], sampled: int, distinct: int, rows: int | None = None, column: str = "") -> dict[str, object]:
    """The shape of a column from the tally of its sample: a verdict at 95 %, a near miss at 50 %."""
    if not sampled or not tally:
        return {}
    best = max(tally, key=lambda k: (tally[k], -ORDER.index(k) if k in ORDER else 0))
    share = tally[best] / sampled
    withheld = best in CHECKED and distinct < 5 or best == "country_code" and distinct < 8 and "country" not in column.lower() or best == "prose" and rows is not None and rows >= 5 * distinct
    if share >= CERTAIN and not withheld:
        return {"looks_like": best, "sampled": sampled, "matched": tally[best]}
    return {"candidate": best, "share": round(share, 6)} if share >= NEAR and not withheld else {}


def epoch_unit(low: Column, high: Column) -> Column:
    """Whether integers between ``low`` and ``high`` are seconds or milliseconds since 1970."""
    return F.when((low >= 1_000_000_000) & (high <= 2_000_000_000), "seconds").when((low >= 1_000_000_000_000) & (high <= 2_000_000_000_000), "milliseconds")
