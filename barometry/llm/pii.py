"""Surrogates for personal data, in Spark's functions only.

Entities (e-mail addresses, phone, card and bank account numbers, IPv4 addresses, names after a
title) are found by one pattern. Phone numbers: E.164 and other international groupings (+ or 00),
North American (3-3-4) and, by a leading 0, European national ones, and Spanish ones in groups.
Cards: 16 digits in fours or unbroken, 15 as 4-6-5 or unbroken. Accounts: IBANs, unbroken or in
fours. Names: one or two words after the title, with inner capitals, apostrophes and hyphens, both
in capitals or neither; where all of a text is in capitals, the word after a lone surname counts as
part of the name. Not found: names without a title or with initials, third words of names, local
numbers without an area, unbroken national numbers without a leading 0, cards of other lengths,
IPv6 and postal addresses, and identity numbers.

Each distinct entity gets a replacement made from a keyed hash (HMAC; the plan holds the key's
pads, so plans are as secret as the key): letters become letters of the same script, digits digits,
signs and each occurrence's capitals stay; card numbers keep their first digit, IBANs their country,
both whether their check digits are right, international phone numbers their country code, others
their first digit. IPv4 addresses stay valid ones; they are not for tables that hold more than
half of all there are. An address's domain is an entity of its own, so addresses of one domain stay
in one. A name's words are entities of their own: a surname has one replacement, under titles of
either gender, with a given name or alone; a given name has one for each gender, with an ending of
that gender. Titles that tell no gender (Dr., Prof.) take that of the same full name under a title
that does, else of the same given name, where the table has it under one gender only; else the
given name's replacement is of neither. Cyrillic and Greek words keep their last letter, which
tells gender there. Letters of other scripts than _SCRIPTS become Latin. Equal entities get equal
replacements everywhere (coreference), however they are punctuated or capitalised, and distinct ones
distinct replacements that are no entity of the corpus: replacements that collide are made anew with
the next attempt's hash until none does; from attempt SHAPED on they are longer by a sign an
attempt (IPv4 addresses excepted), as their shape may have no free value left.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .spans import bound, found, rewritten

KINDS = ("email", "ip", "phone", "card", "iban", "name")
#: Given names (of women, of men, of neither) and domains are entities besides; they count as part of the name or address.
GIVEN = {"f": "given_f", "m": "given_m", "": "given"}
PARTS = ("domain", *GIVEN.values())
_EMAIL = r"(?<![A-Za-z0-9._%+-])[\p{L}0-9][\p{L}0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
_SEPARATED = r"(?:[ ./()-]{0,2}[0-9])"
_PHONE = "|".join((
    rf"\+1{_SEPARATED}{{10}}(?![0-9])",
    rf"(?:\+|(?<![0-9A-Za-z.,+-])00)[1-9]{_SEPARATED}{{6,14}}+(?![0-9])",
    r"(?<![0-9A-Za-z(.,+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z(.,+/-])\(?0[1-9]{_SEPARATED}{{7,11}}+(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z(.,+-])[6-9][0-9]{2}(?:(?:[ .-][0-9]{3}){2}|(?:[ .-][0-9]{2}){3})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z(.,+-])9[0-9] [0-9]{3} [0-9]{2} [0-9]{2}(?![0-9A-Za-z])",
))
_CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|3[47][0-9]{2}(?:[0-9]{11}|[ -][0-9]{6}[ -][0-9]{5}))(?![0-9A-Za-z])"
#: Country, check digits and groups of four; all groups after the bank's hold a digit.
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}(?: ?[0-9]{4}){2}(?: ?(?=[A-Z]{0,3}[0-9])[0-9A-Z]{4}){0,5}(?: ?(?=[A-Z]{0,2}[0-9])[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
_WOMEN, _MEN = r"(?:(?:Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|Dra|Mme|Mlle|Sra|Srta|MRS|MISS|FRAU)\.?|MS\.) ", r"(?:(?:Mr|Herr|Señor|Monsieur|Sr|MR|HERR)\.?|M\.) "
_TITLES = rf"(?:{_WOMEN}|{_MEN}|(?:Dr|Prof)\.? |(?:DR|PROF)\. )+"
#: A word with small letters, and one of capitals; apostrophes and hyphens before capitals are inside.
_MIXED = r"(?=\p{Lu}\p{M}*(?:['’]?\p{Lu}\p{M}*)*+\p{Ll})\p{Lu}(?:[\p{L}\p{M}]|['’-]\p{Lu}(?=[\p{L}\p{M}]))++"
_UPPER = r"\p{Lu}\p{M}*+(?:(?:['’-](?=\p{Lu}\p{Lu}))?\p{Lu}\p{M}*+)++(?!\p{Ll})"
_NAME = rf"(?<!\p{{L}}){_TITLES}(?:{_MIXED}(?: {_MIXED})?|{_UPPER}(?: {_UPPER})?)"
#: Looks at the first character come first: most places of a text pass no further.
PATTERN = "|".join((_EMAIL, _IBAN, rf"(?=[+(0-9])(?:{_IP}|{_CARD}|{_PHONE})", rf"(?=[HFSMDP]){_NAME}"))
_TITLE = f"^({_TITLES})"
#: Letters of each script that stand for each other; fixed values.
_SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöùúûü", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "0123456789")
#: Attempts in an entity's own shape.
SHAPED = 4
#: Made-up names are syllables of these and an ending by gender, or of surnames.
_CONSONANTS, _VOWELS = "bdfgklmnprstvz", "aeiou"
_ENDS = {"given_f": ("na", "lia", "ra", "lla"), "given_m": ("n", "rt", "s", "ro"), "given": ("ley", "rin", "dy", "mi"), "name": ("mann", "son", "ter", "lin", "berg", "ner", "dal", "res")}
#: Country codes of one and of two digits; all others have three.
_ONE, _TWO = "[17]", "2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _kind(value: Column) -> Column:
    return F.when(value.contains("@"), "email").when(value.rlike(f"^(?:{_IBAN})$"), "iban").when(value.rlike(_NAME), "name").when(value.rlike(f"^(?:{_IP})$"), "ip").when(value.rlike(f"^(?:{_CARD})$"), "card").otherwise("phone")


def _norm(kind: Column, value: Column) -> Column:
    """What equal entities share: digits, with a + before a country code, an IBAN's signs without spaces, or the lower-case address, domain or word."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    phone = F.when(value.startswith("+"), F.concat(F.lit("+"), digits)).when(value.startswith("00"), F.concat(F.lit("+"), F.substring(digits, F.lit(3), F.length(digits)))).otherwise(digits)
    return F.when(kind == "phone", phone).when(kind == "card", digits).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "ip", value).otherwise(F.lower(value))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, version (hash of the text) and the spans of each document that has any, each with kind, value, norm (what equal entities share) and, for given names, the surname's norm. A name's title is no part of its span, its given name a span before it; an address's domain is a span after it, whose norm the address's has too."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter(F.col("t").rlike(PATTERN))

    def span(start: Column, end: Column, kind: Column, value: Column, norm: Column | None = None, surname: Column | None = None) -> Column:
        of = F.lower(surname) if surname is not None else F.lit(None).cast("string")
        return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), value.alias("value"), (_norm(kind, value) if norm is None else norm).alias("norm"), of.alias("surname"))

    def of_name(s: Column) -> Column:
        last, title = F.regexp_extract(s.value, r"\S+$", 0), F.regexp_extract(s.value, _TITLE, 1)
        given = F.when(title.rlike(rf"(?<!\p{{L}}){_WOMEN}"), GIVEN["f"]).when(title.rlike(rf"(?<!\p{{L}}){_MEN}"), GIVEN["m"]).otherwise(GIVEN[""])
        first = F.trim(F.substring(s.value, F.length(title) + 1, F.length(s.value) - F.length(title) - F.length(last)))
        begin = s.start + F.length(title)
        surname = span(s.end - F.length(last), s.end, F.lit("name"), last)
        return F.when(F.length(first) > 0, F.array(span(begin, begin + F.length(first), given, first, surname=last), surname)).otherwise(F.array(surname))

    def of_email(s: Column) -> Column:
        local, domain = F.regexp_extract(s.value, "^[^@]+", 0), F.regexp_extract(s.value, "[^@]+$", 0)
        return F.array(span(s.start, s.start + F.length(local), F.lit("email"), local, F.lower(s.value)), span(s.end - F.length(domain), s.end, F.lit("domain"), domain))

    split = lambda s: bound(_kind(s.value), lambda kind: F.when(kind == "name", of_name(s)).when(kind == "email", of_email(s)).otherwise(F.array(span(s.start, s.end, kind, s.value))))
    return text.select("id", F.xxhash64("t").alias("version"), F.flatten(F.transform(found(F.col("t"), PATTERN, "", 0), split)).alias("spans"))


def gendered(spans: DataFrame) -> DataFrame:
    """entities()'s spans as rows, where given names under titles of no gender have the one that the table tells: that of the full name, else of the given name."""
    flat = spans.select("id", "version", F.explode("spans").alias("s")).select("id", "version", "s.*")
    neither = F.col("kind") == GIVEN[""]
    told = flat.filter(F.col("kind").isin(GIVEN["f"], GIVEN["m"]))
    only = lambda name: F.when(F.min(name) == F.max(name), F.min(name))
    # Of a given name's surnames only the distinct genders are gathered, at most two.
    people = told.groupBy("norm", "surname").agg(only("kind").alias("of_person"))
    givens = told.groupBy("norm").agg(only("kind").alias("of_given"))
    known = flat.filter(neither).select("norm", "surname").distinct().join(people, ["norm", "surname"], "left").join(givens, "norm", "left")
    known = known.select("norm", "surname", F.coalesce("of_person", "of_given", F.lit(GIVEN[""])).alias("kind"))
    asked = flat.filter(neither).drop("kind").join(known, ["norm", "surname"])
    return flat.filter(~neither).unionByName(asked).drop("surname")


def _noise(key: str, kind: Column, norm: Column, attempt: Column, n: Column) -> Column:
    """Hex digits from HMAC-SHA-256, 64 for each of n blocks."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    message = lambda k: F.encode(F.concat_ws("\x1f", kind, norm, attempt.cast("string"), k.cast("string")), "utf-8")
    block = lambda k: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message(k)), 256))), 256)
    return F.array_join(F.transform(F.sequence(F.lit(1), n), block), "")


def _like(value: Column, noise: Column) -> Column:
    """value with each letter or digit replaced by one of its script and case; place i reads 4 hex digits of the noise."""

    def one(c: Column, i: Column) -> Column:
        number = F.conv(F.substring(noise, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = F.when(c.rlike(r"\p{Lu}"), F.substring(F.lit(_SCRIPTS[1]), number % 26 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.substring(F.lit(_SCRIPTS[0]), number % 26 + 1, F.lit(1))).otherwise(c)
        for letters in _SCRIPTS:
            out = F.when(F.lit(letters).contains(c), F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit, modulo 10."""
    n = F.length(digits)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10


def _mod97(signs: Column) -> Column:
    """The number that an IBAN's signs stand for, letters as 10 to 35, modulo 97."""
    each = F.filter(F.split(signs, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """rows (kind, norm, attempt) with the replacement at that attempt: the digits alone of phones and cards, the part before the sign of addresses, names in small letters."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt")
    # A word of two letters and a hyphen can take five numbers, other signs one each.
    signs = F.when(kind.isin(*_ENDS), 9).otherwise(16)
    rows = rows.withColumn("noise", _noise(key, kind, norm, attempt, F.greatest(F.lit(1), F.ceil(F.length(norm) / signs).cast("int"))))
    return rows.withColumn("surrogate", _surrogate(key)).drop("noise")


def _surrogate(key: str) -> Column:
    kind, norm, attempt, noise = F.col("kind"), F.col("norm"), F.col("attempt"), F.col("noise")
    same = _like(norm, noise)
    # The first digit of cards and national numbers and the country code of others stay.
    held = lambda n: F.concat(F.substring(norm, F.lit(1), n), F.substring(same, n + 1, F.length(norm)))
    code = F.when(norm.rlike(rf"^\+{_ONE}"), 2).when(norm.rlike(rf"^\+(?:{_TWO})"), 3).when(norm.startswith("+"), 4).otherwise(1)
    card_digits = held(F.lit(1))
    digit = ((10 - _luhn(F.concat(F.substring(card_digits, F.lit(1), F.length(norm) - 1), F.lit("0")))) % 10).cast("string")
    card = F.when(_luhn(norm) == 0, F.concat(F.substring(card_digits, F.lit(1), F.length(norm) - 1), digit)).otherwise(card_digits)
    number = lambda k: F.conv(F.substring(noise, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
    octet = lambda k: (number(F.lit(k)) % 254 + 1).cast("string")
    before = lambda ending: F.substring(norm, F.lit(1), F.length(norm) - F.length(ending))
    host, top = F.regexp_extract(norm, "@.*$", 0), F.regexp_extract(norm, r"\.[a-z]+$", 0)
    land, account = F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.length(norm))

    def made(part: Column, i: Column) -> Column:
        """A word for a part of a name; a beginning such as O' stays."""
        k = lambda at: number(i * 5 + at)
        syllable = lambda n: F.concat(F.substring(F.lit(_CONSONANTS), n % len(_CONSONANTS) + 1, F.lit(1)), F.substring(F.lit(_VOWELS), (n / len(_CONSONANTS)).cast("int") % len(_VOWELS) + 1, F.lit(1)))
        ends = lambda some: F.get(F.array(*map(F.lit, some)), k(4) % len(some))
        end = ends(_ENDS["name"])
        for given in GIVEN.values():
            end = F.when(kind == given, ends(_ENDS[given])).otherwise(end)
        return F.concat(F.regexp_extract(part, r"^\p{L}{1,2}['’]", 0), syllable(k(0)), syllable(k(1)), F.when(k(2) % 2 == 0, syllable(k(3))).otherwise(""), end)

    gendered = F.when(norm.rlike("[α-ωа-я]$"), F.concat(F.substring(same, F.lit(1), F.length(norm) - 1), F.substring(norm, -1, 1))).otherwise(same)
    name = F.when(norm.rlike(r"^[\p{IsLatin}\p{M}'’-]+$"), F.array_join(F.transform(F.split(norm, "-"), made), "-")).otherwise(gendered)
    n_more = F.greatest(F.lit(0), attempt - (SHAPED - 1))
    more = lambda sign: F.when(n_more > 0, _like(F.repeat(F.lit(sign), n_more), _noise(key, F.concat(kind, F.lit("+")), norm, attempt, F.ceil(n_more / 16).cast("int")))).otherwise("")
    money = F.concat(_like(account, noise), more("0"))
    check = F.lpad((98 - _mod97(F.concat(money, land, F.lit("00")))).cast("string"), 2, "0")
    right = _mod97(F.concat(account, F.substring(norm, 1, 4))) == 1
    iban = F.concat(land, F.when(right, check).otherwise(F.substring(norm, 3, 2)), money)
    out = F.when(kind == "card", F.concat(card, more("0"))).when(kind == "phone", F.concat(held(code), more("0"))).when(kind == "ip", F.concat_ws(".", *map(octet, range(4)))).when(kind == "iban", iban)
    return out.when(kind == "email", F.concat(more("a"), _like(before(host), noise))).when(kind == "domain", F.concat(more("a"), _like(before(top), noise), top)).otherwise(F.concat(name, more("a")))


def surrogates(rows: DataFrame, key: str) -> DataFrame:
    """(kind, norm) -> surrogate for every distinct entity of gendered()'s rows, in the form of _with_surrogate()."""
    spark = rows.sparkSession
    # A fixed number of tasks: the rows are small and their hashes are not.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = scratch.cut(rows.select("kind", "norm").distinct().repartition(tasks, "norm"), "entities")
    made = scratch.cut(_with_surrogate(known.repartition(tasks, "norm").withColumn("attempt", F.lit(0)), key), "surrogates")
    # Names of all kinds share one space of words, addresses have one for each domain, other kinds one each.
    space = F.when(F.col("kind").isin(*GIVEN.values()), "name").when(F.col("kind") == "email", F.regexp_extract("norm", "@.*$", 0)).otherwise(F.col("kind")).alias("space")
    taken = F.when(F.col("kind") == "email", F.regexp_extract("norm", "^[^@]+", 0)).otherwise(F.col("norm"))
    real = scratch.cut(known.select(space, taken.alias("surrogate")).distinct().withColumn("real", F.lit(True)), "real-entities")
    while True:
        spaced = made.withColumn("space", space)
        first = spaced.groupBy("space", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("first"))
        judged = spaced.join(first, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left").withColumn("again", (F.struct("norm", "kind") != F.col("first")) | F.col("real").isNotNull())
        judged = scratch.cut(judged.select("kind", "norm", "attempt", "surrogate", "again"), "judged")
        if not judged.filter("again").limit(1).count():
            return judged.select("kind", "norm", "surrogate")
        redone = _with_surrogate(judged.filter("again").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")).repartition(tasks, "norm"), key)
        made = scratch.cut(judged.filter(~F.col("again")).select("kind", "norm", "attempt", "surrogate").unionByName(redone), "surrogates")


def _formatted(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the occurrence's own punctuation and capitals."""
    signs = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    # The signs to fill in, in order; a country code may be written as 00.
    zeros = F.when(value.startswith("00") & surrogate.startswith("+"), "00").otherwise("")
    new = F.concat(zeros, F.regexp_replace(surrogate, r"^\+", ""))
    upto = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^0-9A-Z]", ""))
    # A surrogate of a later attempt may have more of them.
    filled = F.concat(F.array_join(F.transform(signs(value), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(new, upto(i + 1), F.lit(1))).otherwise(c)), ""), F.substring(new, F.length(F.regexp_replace(value, "[^0-9A-Z]", "")) + 1, F.length(new)))
    ahead = F.length(surrogate) - F.length(value)
    capital = lambda i: F.substring(value, F.greatest(i - ahead, F.lit(0)) + 1, F.lit(1)).rlike(r"\p{Lu}") & (i >= ahead)
    address = F.when(value == F.lower(value), surrogate).otherwise(F.array_join(F.transform(signs(surrogate), lambda c, i: F.when(capital(i), F.upper(c)).otherwise(c)), ""))
    words = F.regexp_replace(F.initcap(F.regexp_replace(surrogate, "(['’-])", "$1 ")), "(['’-]) ", "$1")
    name = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(words)
    return F.when(kind.isin("phone", "card", "iban"), filled).when(kind.isin("email", "domain"), address).when(kind == "ip", surrogate).otherwise(name)


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_entities and n_<kind> of each document, and its text with all entities replaced.

    Documents without entities never leave their scan. Null texts stay null; rows of equal id
    (null or not) and text are treated alike; an empty table gives an empty one; other columns
    are not read.
    """
    spans = scratch.cut(entities(docs, id_col, text_col).dropDuplicates(["id", "version"]), "spans")
    flat = scratch.cut(gendered(spans), "entities-in-place")
    new = flat.join(surrogates(flat, key), ["kind", "norm"]).withColumn("new", _formatted(F.col("value"), F.col("kind"), F.col("surrogate")))
    marks = new.groupBy(F.struct("id", "version").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "new"))).alias("marks")).select("doc.*", "marks")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    of_kind = lambda k: F.size(F.filter("marks", lambda m: m.kind == k)).cast("long").alias(f"n_{k}")
    count = [of_kind(k) for k in KINDS]
    own = rows.filter(has).withColumn("own", F.xxhash64("text"))
    both = own.join(marks.withColumnRenamed("id", "marked"), own["id"].eqNullSafe(F.col("marked")) & (F.col("own") == F.col("version")))
    changed = both.select("id", F.size(F.filter("marks", lambda m: ~m.kind.isin(*PARTS))).cast("long").alias("n_entities"), *count, rewritten(F.col("text"), F.col("marks")).alias("text"))
    same = rows.filter(~has).select("id", F.lit(0).cast("long").alias("n_entities"), *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS), "text")
    return same.unionByName(changed).withColumnRenamed("id", id_col)
