"""Format-preserving pseudonyms: a keyed Feistel network over column expressions alone.

What a pattern finds and its rule validates is permuted within its own format: digits stay digits,
capitals and small letters stay such, check digits are right, dates and addresses exist. A value's
pseudonym depends on the key and on its canonical form (without separators), so equal values stay
linked across documents however they are written. Every permutation is a bijection on its format, but
for the check digits, which follow from the rest.

Kinds: email, card (an issuer's leading digits and Luhn), iban (mod 97), ssn, phone, ipv4, mac, date, and
credentials (access keys, tokens, passwords). Whatever looks like one and fails its rule stays as it is;
of a card or an IBAN the readings that end at an earlier space are tried too, and what follows such a
reading is searched again.

The key is a secret of the caller: a parameter, or KEY_CONF of the session. Where neither is set, a
session draws a key of its own, so that nothing outside it can undo or link its pseudonyms.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
#: Where a session holds the key; Spark's default redaction hides the value of a setting with such a name.
KEY_CONF = "spark.quern.pseudonyms.secret"
#: What payment card numbers of 13 to 19 digits start with, by issuer.
ISSUERS = "4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|309|3[689]|352[89]|35[3-8]|50|5[6-9]|6"
#: Dates from 1800-01-01 to DATE_HALF ** 2 days later are permuted among themselves.
FIRST_DAY, DATE_HALF = "1800-01-01", 340
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Patterns of each kind, in the order in which they are tried at a place. None starts inside a run of letters and digits; BEFORE says so for all.
BEFORE = r"(?<![A-Za-z0-9])"
PATTERNS = {
    "email": r"(?<![._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "credential": r"(?=[AaPpSsTt])(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api_key|apikey)\s?[=:]\s?\"?[A-Za-z0-9_+/-]{8,}+)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<!:)[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![A-Za-z0-9:])",
    "ipv4": rf"(?=\d)(?<!\d\.){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "date": r"(?=\d)(?<!\d[./-])(?:\d{4}(?:-\d{2}-\d{2}|/\d{2}/\d{2}|\.\d{2}\.\d{2})|\d{1,2}(?:-\d{1,2}-|/\d{1,2}/|\.\d{1,2}\.)\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!-)\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
    "phone": r"(?=[\d+(])(?<!\d\.)(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d))",
}
ANY = BEFORE + "(?:" + "|".join(PATTERNS.values()) + ")"
#: A text is searched once, and again behind shorter readings. A match found there begins in what the last one left over,
#: which is under 32 characters; a value has 12 at least. So three more rounds are as many as any text can need.
SEARCHES = 4
#: A text without any of these has no match.
SOME = "[0-9@=:]|A[KS]IA"


def let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def session_key(spark: SparkSession) -> str:
    """The session's key; one is drawn where none is set."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        spark.conf.set(KEY_CONF, key := secrets.token_hex(32))
    return key


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def feistel(s: Column, key: str, tweak: str) -> Column:
    """A permutation of the strings of one shape: every digit, small letter and capital moves within its class, other characters and the length stay. Each round shifts one half, character by character, by a hash of the other half."""

    def shifted(part: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(stream, 4 * (i % 32) + 1, F.lit(4)), 16, 10).cast("int")
            move = lambda first, size: F.char(F.lit(first) + F.pmod(F.ascii(c) - first + by, F.lit(size)))
            return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)

        return F.when(F.length(part) == 0, part).otherwise(F.array_join(F.transform(F.split(part, ""), one), ""))

    def turn(state: Column, n: Column) -> Column:
        """The left half takes the right half's place, the right half shifted by the left one's hash."""
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), n.cast("string"), state["b"]), 512)
        return F.struct(state["b"].alias("a"), let(stream, lambda x: shifted(state["a"], x)).alias("b"))

    def whole(s: Column) -> Column:
        half = F.floor((F.length(s) + 1) / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["a"], x["b"]))

    return let(s, whole)


def numbers(a: Column, b: Column, size: int, key: str, tweak: str) -> Column:
    """A permutation of pairs of numbers below size, as a struct of a and b."""

    def turn(state: Column, n: Column) -> Column:
        by = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), n.cast("string"), state["b"].cast("string")), 256), 1, 12), 16, 10).cast("long")
        return F.struct(state["b"].alias("a"), F.pmod(state["a"] + by, F.lit(size)).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def refill(shape: Column, chars: Column, cls: str) -> Column:
    """shape with its characters of class cls replaced by those of chars, in order."""

    def one(i: Column) -> Column:
        c = F.substring(shape, i, 1)
        nth = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), f"[^{cls}]", ""))
        return F.when(c.rlike(f"[{cls}]"), F.substring(chars, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(shape), F.lit(1))), one), "")


def luhn(d: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits, check digit included."""

    def one(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def mod97(s: Column) -> Column:
    """A string of digits and capital letters (A = 10 ...) as a number, modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0), add)


def is_card(d: Column) -> Column:
    """13 to 19 digits that an issuer's numbers start with, and a Luhn sum of 0."""
    return F.length(d).between(13, 19) & d.rlike(f"^(?:{ISSUERS})") & (luhn(d) == 0)


def card(m: Column, key: str) -> Column:
    """The digits that tell the issuer stay: the first one of a number that starts with 4, else the first four. The others but the check digit are permuted."""

    def of(d: Column) -> Column:
        kept = F.when(d.startswith("4"), 1).otherwise(4)
        body = F.concat(F.substring(d, F.lit(1), kept), feistel(F.substring(d, kept + 1, F.length(d) - kept - 1), key, "card"))
        whole = let(body, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(is_card(d), let(whole, lambda x: refill(m, x, "0-9"))).otherwise(m)

    return let(_digits(m), of)


def iban(m: Column, key: str) -> Column:
    def of(flat: Column) -> Column:
        country, account = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat))
        whole = let(feistel(account, key, "iban"), lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
        return F.when(mod97(F.concat(account, F.substring(flat, 1, 4))) == 1, let(whole, lambda x: refill(m, x, "A-Z0-9"))).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999 are permuted among themselves: area and group as one number, the serial as another, each moved by a hash of the other in turn."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    by = lambda n, x: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ssn"), n.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def turn(state: Column, n: Column) -> Column:
        return F.when(n % 2 == 0, F.struct(F.pmod(state["a"] + by(n, state["b"]), F.lit(898 * 99)).alias("a"), state["b"].alias("b"))).otherwise(F.struct(state["a"].alias("a"), F.pmod(state["b"] + by(n, state["a"]), F.lit(9999)).alias("b")))

    flat = (area - F.when(area > 666, 2).otherwise(1)) * 99 + (group - 1)
    start = F.struct(flat.cast("long").alias("a"), (serial - 1).cast("long").alias("b"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")

    def told(x: Column) -> Column:
        at = F.floor(x["a"] / 99) + 1
        return F.concat_ws("-", pad(at + F.when(at >= 666, 1).otherwise(0), 3), pad(x["a"] % 99 + 1, 2), pad(x["b"] + 1, 4))

    return F.when(valid, let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), told)).otherwise(m)


def ipv4(m: Column, key: str) -> Column:
    part = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    return let(let(octets, lambda o: numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, key, "ipv4")), lambda x: F.concat_ws(".", *part(x["a"]), *part(x["b"])))


def date(m: Column, key: str) -> Column:
    """Year first, or else day and month by what exists (day first unless only month first does). The layout, separators and padding stay; dates outside the range stay too."""
    start = F.lit(FIRST_DAY).cast("date")
    ymd = lambda y, mo, d: F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def read(p: Column) -> Column:
        first, dmy = F.length(p[0]) == 4, ymd(p[2], p[1], p[0])
        day = F.when(first, ymd(p[0], p[1], p[2])).otherwise(F.coalesce(dmy, ymd(p[2], p[0], p[1])))
        wide = first | ((F.length(p[0]) == 2) & (F.length(p[1]) == 2))
        return F.struct(F.datediff(day, start).alias("n"), F.when(first, "ymd").when(dmy.isNotNull(), "dmy").otherwise("mdy").alias("order"), wide.alias("wide"))

    def told(x: Column, new: Column) -> Column:
        sep = F.regexp_extract(m, r"(\D)", 1)
        text = lambda c: F.when(x["wide"], F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
        y, mo, d = F.lpad(F.year(new).cast("string"), 4, "0"), text(F.month(new)), text(F.dayofmonth(new))
        return F.when(x["order"] == "ymd", F.concat(y, sep, mo, sep, d)).when(x["order"] == "dmy", F.concat(d, sep, mo, sep, y)).otherwise(F.concat(mo, sep, d, sep, y))

    def moved(x: Column) -> Column:
        pair = numbers(F.floor(x["n"] / DATE_HALF), x["n"] % DATE_HALF, DATE_HALF, key, "date")
        new = let(pair, lambda v: F.date_add(start, (v["a"] * DATE_HALF + v["b"]).cast("int")))
        return F.when(x["n"].between(0, DATE_HALF * DATE_HALF - 1), let(new, lambda day: told(x, day))).otherwise(m)

    return let(let(F.split(m, r"\D"), read), moved)


def phone(m: Column, key: str) -> Column:
    """The last ten digits are permuted (all, of shorter numbers, but one after a plus sign); what stands before them stays."""

    def of(d: Column) -> Column:
        own = F.least(F.length(d) - F.when(m.startswith("+"), 1).otherwise(0), F.lit(10))
        new = F.concat(F.substring(d, F.lit(1), F.length(d) - own), feistel(F.substring(d, F.length(d) - own + 1, own), key, "phone"))
        return F.when(F.length(d).between(7, 15), let(new, lambda x: refill(m, x, "0-9"))).otherwise(m)

    return let(_digits(m), of)


def email(m: Column, key: str) -> Column:
    """The local part is permuted; the domain stays."""
    return let(F.substring_index(m, "@", 1), lambda local: F.concat(feistel(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m))))


def credential(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r'^(A[KS]IA|(?i:[a-z_]+)\s?[=:]\s?"?)', 1)
    return let(name, lambda x: F.concat(x, feistel(F.substring(m, F.length(x) + 1, F.length(m)), key, "credential")))


def mac(m: Column, key: str) -> Column:
    """The 48 bits are permuted. Written in capitals alone, capitals stay; where both cases stand, each letter takes the case of the character in its place."""
    half = lambda at: F.conv(F.substring(F.replace(m, F.lit(":"), F.lit("")), at, 6), 16, 10).cast("long")
    pair = numbers(half(1), half(7), 1 << 24, key, "mac")
    flat = let(pair, lambda x: F.lower(F.concat(F.lpad(F.hex(x["a"]), 6, "0"), F.lpad(F.hex(x["b"]), 6, "0"))))
    small = let(flat, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(x, 2 * i + 1, F.lit(2))), ":"))

    def cased(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.when(F.substring(m, i, F.lit(1)).between("A", "F"), F.upper(F.substring(x, i, F.lit(1)))).otherwise(F.substring(x, i, F.lit(1))))
        return F.when(~m.rlike("[A-F]"), x).when(~m.rlike("[a-f]"), F.upper(x)).otherwise(F.array_join(each, ""))

    return let(small, cased)


KINDS = {"email": email, "credential": credential, "iban": iban, "mac": mac, "ipv4": ipv4, "date": date, "ssn": ssn, "card": card, "phone": phone}


def kind(m: Column) -> Column:
    """Name of the first kind whose pattern is the whole match."""
    out = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        out = F.when(m.rlike(rf"\A(?:{PATTERNS[name]})\z"), F.lit(name)).otherwise(out)
    return out


def read(m: Column, of: Column) -> Column:
    """How many characters of a match of a kind are its value: of a card or an IBAN the longest reading that ends at a space or the match's end, has enough digits or characters and is valid; all, if none is."""

    def longest(valid) -> Column:
        ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), lambda i: (i == F.length(m)) | (F.substring(m, i + 1, F.lit(1)) == " "))
        return F.coalesce(F.get(F.filter(ends, lambda i: valid(F.substring(m, F.lit(1), i))), F.lit(0)), F.length(m))

    cards = lambda x: let(_digits(x), is_card)
    ibans = lambda x: let(F.replace(x, F.lit(" "), F.lit("")), lambda f: (F.length(f) >= 12) & (mod97(F.concat(F.substring(f, F.lit(5), F.length(f)), F.substring(f, 1, 4))) == 1))
    return F.when(of == "card", longest(cards)).when(of == "iban", longest(ibans)).otherwise(F.length(m))


def pseudonym(m: Column, key: str) -> Column:
    """new, the pseudonym of a match (the match itself where it is not valid), n, whether they differ, and rest, the match's end that is not part of the value."""

    def by(of: Column) -> Column:
        def whole(value: Column) -> Column:
            out = value
            for name, make in KINDS.items():
                out = F.when(of == name, make(value, key)).otherwise(out)
            return let(out, lambda x: F.struct(x.alias("new"), (x != value).cast("int").alias("n"), F.substring(m, F.length(value) + 1, F.length(m)).alias("rest")))

        return let(let(read(m, of), lambda n: F.substring(m, F.lit(1), n)), whole)

    return let(kind(m), by)


def pseudonymize(docs: DataFrame, *, key: str | None = None, text: str = "text") -> DataFrame:
    """The columns of docs, with _text and _n_replaced: one row per row of docs. key: the session's, if none is given. Null texts stay null, empty texts empty; rows that repeat stay and get the same text; an empty table gives none; no row sees another, nothing is shuffled; columns with a name that is used here give way.

    A text is cut at its matches by one pattern; the matches are replaced and set between the pieces again. What a match leaves over is searched once more with the piece behind it: a match found there begins in what was left over."""
    docs = common.giving_way(docs, "_text", "_n_replaced", "_new")
    key = key or session_key(docs.sparkSession)
    hit = F.coalesce(F.col(text).rlike(SOME) & F.col(text).rlike(ANY), F.lit(False))
    part = lambda t, n, again: F.struct(t.alias("text"), n.cast("int").alias("n"), again.alias("again"))

    def searched(t: Column) -> Column:
        """A text as parts: pieces, pseudonyms, and pieces to be searched again."""
        cut = F.struct(F.split(t, ANY, -1).alias("pieces"), F.transform(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key)).alias("found"))

        def told(x: Column) -> Column:
            behind = lambda y, i: F.array(part(y["new"], y["n"], F.lit(False)), part(F.concat(y["rest"], F.get(x["pieces"], i + 1)), F.lit(0), y["rest"] != ""))
            return F.concat(F.array(part(F.get(x["pieces"], F.lit(0)), F.lit(0), F.lit(False))), F.flatten(F.transform(x["found"], behind)))

        return let(cut, told)

    def turn(parts: Column, _: Column) -> Column:
        return F.when(F.exists(parts, lambda p: p["again"]), F.flatten(F.transform(parts, lambda p: F.when(p["again"], searched(p["text"])).otherwise(F.array(p))))).otherwise(parts)

    start = F.array(part(F.col(text), F.lit(0), F.lit(True)))
    joined = lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.aggregate(parts, F.lit(0), lambda n, p: n + p["n"]).alias("n"))
    done = docs.withColumn("_new", F.when(hit, F.aggregate(F.sequence(F.lit(1), F.lit(SEARCHES)), start, turn, joined)))
    return done.select(*docs.columns, F.coalesce(F.col("_new.text"), F.col(text)).alias("_text"), F.coalesce(F.col("_new.n"), F.lit(0)).cast("long").alias("_n_replaced"))


def op1_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs).select("doc_id", F.col("_text").alias("text"), F.col("_n_replaced").alias("n_replaced"))
