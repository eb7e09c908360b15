"""Personal data replaced by keyed surrogates, with DataFrame functions only.

1. One expression finds e-mail addresses, IBANs, card, phone and social security numbers, IPv4 addresses and names (after
   a title, or a listed given name before a capitalised one) in the whole text.
2. Every distinct entity, in canonical form (lower case, or digits only), gets a surrogate from a keyed hash: digits for
   digits and letters for letters, the country code, first card digit, top-level domain and valid check digits (Luhn, IBAN) kept,
   names by gender and script. An entity has one surrogate in the whole corpus, so what was the same stays the same; a word
   of a name is one entity wherever it stands in a name, with the first role (f, m, n: unknown, s: surname) that it has somewhere.
3. Surrogates are checked: one that equals another entity's surrogate, or any entity found in the corpus, is drawn again
   with the next attempt, until none is left. So what was different stays different.
4. Each occurrence takes its entity's surrogate in its own punctuation and case. In a document with names, the words of these
   names are replaced wherever they stand capitalised: alone, in another order, or in capitals.

The key is the secret that keeps surrogates from being recomputed; it comes from the session setting KEY_SETTING.

Cheap tests (an @, a run of digits, a listed word) spare most texts the expression. Its repetitions are of single characters or
possessive, so no length of text or token exhausts the stack. Only documents with an entity are
written down and shuffled, once; entities are made distinct within map tasks first, and a join on a
frequent entity may be split by Spark. Documents without one pass through unmoved.

Edge cases: a null text stays null and has no entities; a null doc_id is kept; repeated rows are replaced alike; an empty
table gives an empty result; columns named in `keep` are carried along, others are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorgrid.llm.shared import stored

KEY_SETTING = "spark.sensorgrid.surrogate.key"
#: The key of the registered queries where none is set: for tests, as anybody can read it here.
TEST_KEY = "known to everybody"
#: Attempts after which surrogates get further characters (an address a longer form), for formats with too few values for their entities.
ROUNDS = 12

#: Titles by gender, and given names by gender.
TITLES = {"m": "Mr Herr Monsieur Señor Sr г-н", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra г-жа", "n": "Dr Prof"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Peter Paul Hans Jürgen Klaus Pierre Jean Luc Carlos José Juan Иван Сергей Алексей Γιώργος Νίκος",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Anna Emma Julia Sophie Greta Ursula Camille Claire María Carmen Lucía Анна Елена Ольга Μαρία Ελένη",
}
#: Beginnings and endings of invented names by script; endings by gender, and of surnames.
BEGINNINGS = {
    "latin": "Al Bar Cor Dan El Fer Gar Hal Ir Jor Kal Lor Mar Nor Or Per Ran Sal Tor Ul Val Wil Yor Zan",
    "cyrillic": "Ал Бор Вер Гор Дан Ел Жел Зор Ив Кор Лев Мар Ник Ол Пав Род Сав Тим Ул Фед",
    "greek": "Αλ Βασ Γερ Δημ Ελ Ζην Θεο Ιασ Καλ Λεων Μαρ Νικ Ορ Παν Ροδ Στρ Τιμ Φιλ Χρυσ",
}
ENDINGS = {
    "latin": {"m": "an er us o in ald", "f": "a ia ina elle ette isa", "n": "is y en el ey", "s": "son er mann feld ez eau"},
    "cyrillic": {"m": "ан ей ил ир", "f": "а ия ина ана", "n": "и ень", "s": "енко ук ский ин"},
    "greek": {"m": "ος ης ας", "f": "α η ια", "n": "ι ω", "s": "ίδης όπουλος άκης"},
}
_MIDDLE = "ba be bo da de do ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo"
MIDDLES = {"latin": _MIDDLE, "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро", "greek": "βα δα κα λα μα να ρα σα τα βε δε κε λε με νε ρε σε τε"}


def _one_of(words: str) -> str:
    return "(?:" + "|".join(words.split()) + ")"


_TITLE = _one_of(" ".join(TITLES.values()))
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]+|(?=['’-]\p{Lu}))(?:['’-]\p{L}[\p{L}\p{M}]+)*+"
_CARD = "(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": rf"(?<![0-9A-Za-z]){_CARD}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?<![0-9][.-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![.-]?[0-9])|(?<![0-9A-Za-z])\+[0-9]{8,15}(?![0-9])",
    "person": rf"(?<![\p{{L}}\p{{M}}])(?:{_TITLE}\.? {_NAME}(?: {_NAME})?|{_one_of(' '.join(GIVEN.values()))}(?:-{_NAME})? {_NAME})",
}
#: What every match of some kind but names holds, and the words of which a name holds one: cheap tests before the expression.
_DIGITS = r"[0-9][0-9 .()-]{4,}[0-9]|[A-Z]{2}[0-9]{2}"
_NAMED = tuple(dict.fromkeys(" ".join([*TITLES.values(), *GIVEN.values()]).split()))
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
KINDS = tuple(PATTERNS)
#: Entities, or else capitalised words.
ANY_WORD = rf"{ANY}|(?<![\p{{L}}\p{{M}}]){_NAME}"


def configured_key(spark: SparkSession, otherwise: str | None = None) -> str:
    """The key that the session names; an error if it names none and there is no other."""
    key = spark.conf.get(KEY_SETTING, None) or otherwise
    if not key:
        raise ValueError(f"{KEY_SETTING} is not set")
    return key


def has_entity(text: Column) -> Column:
    """Whether a text holds an entity; the whole expression runs only where one of the cheap tests passes."""
    maybe = reduce(lambda a, w: a | F.contains(text, F.lit(w)), _NAMED, F.contains(text, F.lit("@")) | F.rlike(text, F.lit(_DIGITS)))
    return F.coalesce(F.when(maybe, F.rlike(text, F.lit(ANY))), F.lit(False))


def _kind(match: Column) -> Column:
    """The kind of a whole match, from its shape; a match of one word is none of KINDS."""
    return (
        F.when(F.contains(match, F.lit("@")), "email")
        .when(F.rlike(match, F.lit(r"^[A-Z]{2}[0-9]{2}")), "iban")
        .when(F.rlike(match, F.lit(f"^{_CARD}$")), "card")
        .when(F.rlike(match, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "ssn")
        .when(F.rlike(match, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), "ip")
        .when(F.rlike(match, F.lit(r"^[+(0-9]")), "phone")
        .when(F.contains(match, F.lit(" ")), "person")
        .otherwise("word")
    )


def _list(words: str) -> Column:
    """The words as one constant array."""
    return F.split(F.lit(words), " ")


def _in(word: Column, words: str) -> Column:
    return F.array_contains(_list(words), word)


def _parts(match: Column) -> Column:
    """Array of (token, kind, canonical, role): the match itself, or the words of a name; kind is null for what stays."""
    kind = _kind(match)
    canonical = (
        F.when(kind.isin("email", "word"), F.lower(match)).when(kind == "ip", match).when(kind == "iban", F.regexp_replace(match, " ", ""))
        .otherwise(F.regexp_replace(match, "[^0-9]", ""))
    )
    whole = F.array(F.struct(match.alias("token"), kind.alias("kind"), canonical.alias("canonical"), F.lit("").alias("role")))

    def bare(token: Column) -> Column:
        return F.regexp_replace(token, r"\.$", "")

    def listed(token: Column) -> Column:
        """The gender of a listed given name, else null."""
        first = F.split_part(F.initcap(token), F.lit("-"), F.lit(1))
        return F.when(_in(first, GIVEN["m"]), "m").when(_in(first, GIVEN["f"]), "f")

    def named(tokens: Column) -> Column:
        every = " ".join(TITLES.values())
        titled = _in(bare(tokens[0]), every)
        first = F.when(titled, F.lit(1)).otherwise(F.lit(0))
        told = reduce(lambda c, g: c.when(_in(bare(tokens[0]), TITLES[g]), F.lit(g)), "mf", F.when(F.lit(False), F.lit("n")))
        gender = F.coalesce(told, F.lit("n"))

        def part(token: Column, i: Column) -> Column:
            script = F.when(F.rlike(token, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(token, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")
            last = F.when((i == F.size(tokens) - 1) & ((F.size(tokens) - first > 1) | titled), F.lit("s")).otherwise(gender)
            name = (i >= first) & ~_in(bare(token), every)
            role = F.concat_ws("_", script, F.coalesce(listed(token), last))
            return F.struct(token.alias("token"), F.when(name, F.lit("name")).alias("kind"), F.when(name, F.lower(token)).alias("canonical"), F.when(name, role).alias("role"))

        return F.transform(tokens, part)

    # The outer transform binds the words of the match once.
    return F.when(kind == "person", F.transform(F.array(F.split(match, " ")), named)[0]).otherwise(whole)


def _number(digest: Column, at: Column | int, below: Column | int) -> Column:
    """The at-th number that a 128-digit hexadecimal hash gives, from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substr(digest, F.pmod(at * 5, F.lit(120)) + 1, F.lit(5)), 16, 10).cast("long") % below).cast("int")


def _each(text: Column, change) -> Column:
    """Text with every character replaced by change(character, place from 0)."""
    return F.array_join(F.transform(F.split(text, F.lit("")), change), "")


def _like(digest: Column, c: Column, i: Column) -> Column:
    """A character of the same class, or the same one if it is neither a digit nor a letter."""
    pick = lambda s: F.substr(F.lit(s), _number(digest, i, len(s)) + 1, F.lit(1))
    return F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789")).when(F.rlike(c, F.lit("[a-z]")), pick("abcdefghijklmnopqrstuvwxyz")).when(F.rlike(c, F.lit("[A-Z]")), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)


def luhn(digits: Column) -> Column:
    """Sum whose last digit is 0 for a number with a valid check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def mod97(iban: Column) -> Column:
    """1 for an IBAN with valid check digits."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), F.lit(""))
    return F.aggregate(turned, F.lit(0), lambda total, c: F.when(F.rlike(c, F.lit("[0-9]")), total * 10 + F.try_to_number(c, F.lit("9")).cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97)


def _name(digest: Column, role: Column, attempt: int) -> Column:
    """An invented name for a script and role; each other attempt has one more syllable, so that names never run out."""

    def pick(words: str, at: int) -> Column:
        return F.element_at(_list(words), _number(digest, at, len(words.split())) + 1)

    out = F.when(F.lit(False), F.lit(""))
    for script, roles in ENDINGS.items():
        syllables = 2 + attempt // 2
        for kind, endings in roles.items():
            out = out.when(role == f"{script}_{kind}", F.concat(pick(BEGINNINGS[script], 0), *(pick(MIDDLES[script], 1 + k) for k in range(syllables)), pick(endings, syllables + 1)))
    return F.lower(out)


def surrogate(kind: Column, canonical: Column, role: Column, attempt: int, key: str) -> Column:
    """The canonical form of a surrogate of the same kind and format."""
    message = F.concat_ws("\x1f", kind, canonical, F.lit(str(attempt)))
    digest = F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), message), 512)), 512)

    def made(d: Column) -> Column:
        n = F.length(canonical)
        top = F.length(F.regexp_extract(canonical, r"\.[a-z]+$", 0))
        drawn = _each(canonical, lambda c, i: _like(d, c, i))

        def kept(head: Column | int, tail: Column | int = 0) -> Column:
            """The canonical form's first and last characters around drawn ones."""
            head, tail = (F.lit(x) if isinstance(x, int) else x for x in (head, tail))
            return F.concat(F.substr(canonical, F.lit(1), head), F.substr(drawn, head + 1, n - head - tail), F.substr(canonical, n - tail + 1, tail))

        code = F.greatest(n - 10, F.lit(0))
        phone = F.concat(F.substr(canonical, F.lit(1), code), (_number(d, code, 8) + 2).cast("string"), F.substr(drawn, code + 2, n))
        card = kept(1)
        body = F.substr(card, F.lit(1), n - 1)
        check = F.pmod(F.lit(10) - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        card = F.when(luhn(canonical) % 10 == 0, F.concat(body, check)).otherwise(card)
        country, account = F.substr(canonical, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5))
        digits = F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
        iban = F.when(mod97(canonical) == 1, F.concat(country, digits, account)).otherwise(kept(2))
        ip = F.concat_ws(".", (_number(d, 0, 223) + 1).cast("string"), *(_number(d, k, 256).cast("string") for k in (1, 2)), (_number(d, 3, 254) + 1).cast("string"))
        if attempt > ROUNDS:  # an address of the longer kind, in its private range
            ip = F.concat(F.lit("fd"), *(F.concat(F.substr(d, F.lit(1 + 4 * k), F.lit(4 if k else 2)), F.lit("" if k == 7 else ":")) for k in range(8)))
        return (
            F.when(kind == "email", kept(0, top)).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", drawn)
            .when(kind == "iban", iban).when(kind == "ip", ip).otherwise(_name(d, role, attempt))
        )

    value = F.transform(F.array(digest), made)[0]  # binds the hash once
    if attempt <= ROUNDS:
        return value
    more = F.substr(F.regexp_replace(digest, "[^0-9]", ""), F.lit(1), F.lit(attempt - ROUNDS))
    return F.when(kind == "email", F.concat(more, value)).when(kind.isin("ip", "name"), value).otherwise(F.concat(value, more))


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, canonical, surrogate) of distinct entities (kind, canonical, role), checked as the module says."""
    entities = stored(entities, "entities")
    pending, done, attempt = entities, None, 0
    while True:
        # Written at once, so that the long expression is planned in a plan of its own.
        drawn = stored(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("role"), attempt, key)), "surrogates")
        first = Window.partitionBy("kind", "surrogate").orderBy("canonical")
        drawn = drawn.withColumn("place", F.row_number().over(first))
        taken = entities.select("kind", F.col("canonical").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        taken = taken.distinct().withColumn("taken", F.lit(True))
        drawn = stored(drawn.join(taken, ["kind", "surrogate"], "left").withColumn("good", F.col("taken").isNull() & (F.col("place") == 1)), "drawn")
        good = drawn.where("good").select("kind", "canonical", "surrogate")
        done = good if done is None else done.union(good)
        pending = drawn.where("not good").select("kind", "canonical", "role")
        if pending.isEmpty():
            return done
        attempt += 1


def _rendered(part: Column, told: Column) -> Column:
    """The surrogate in the punctuation and case of the occurrence."""
    token, kind = part["token"], part["kind"]

    def into_slots(slot: str) -> Column:
        outside = f"[^{slot}]"
        filled = _each(token, lambda c, i: F.when(F.rlike(c, F.lit(f"[{slot}]")), F.substr(told, F.length(F.regexp_replace(F.substr(token, F.lit(1), i + 1), outside, "")), F.lit(1))).otherwise(c))
        return F.concat(filled, F.substr(told, F.length(F.regexp_replace(token, outside, "")) + 1, F.lit(100)))

    cased = F.array_join(F.zip_with(F.split(told, F.lit("")), F.split(token, F.lit("")), lambda c, t: F.when(F.rlike(t, F.lit("[A-Z]")), F.upper(c)).otherwise(c)), "")
    name = F.when((F.length(token) > 1) & (F.upper(token) == token), F.upper(told)).otherwise(F.concat(F.upper(F.substr(told, F.lit(1), F.lit(1))), F.substr(told, F.lit(2), F.lit(100))))
    return F.when(kind.isNull() | told.isNull(), token).when(kind == "email", cased).when(kind == "ip", told).when(kind == "iban", into_slots("A-Z0-9")).when(kind.isin("name", "word"), name).otherwise(into_slots("0-9"))


def replace(docs: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, text, entities, *keep): entities is a map from kind to the number of entities found; words of names that
    stand alone are replaced without being counted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.struct(*keep).alias("kept") for _ in [0] if keep))
    some = has_entity(F.col("text"))
    # Written, as both the entities and the new texts come from it.
    found = stored(rows.where(some), "found").withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.hash("text", "doc_id")})
    found = found.withColumn("found", F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), _parts))
    parts = found.select("k1", "k2", F.explode(F.flatten("found")).alias("part")).where("part.kind is not null").select("k1", "k2", "part.kind", "part.canonical", "part.role").distinct()
    known = mapping(parts.groupBy("kind", "canonical").agg(F.min("role").alias("role")), key)
    # What is gathered for a document is bounded by its own entities.
    entry = F.struct(F.concat_ws(" ", "kind", "canonical").alias("entity"), F.col("surrogate"))
    told = parts.select("k1", "k2", "kind", "canonical").distinct().join(known, ["kind", "canonical"]).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(entry)).alias("told"))
    joined = found.join(told, ["k1", "k2"], "left")
    kinds = F.transform("found", lambda parts: F.when(F.coalesce(parts[0]["kind"], F.lit("name")) == "name", "person").otherwise(parts[0]["kind"]))

    def render(part: Column) -> Column:
        kind = F.when(part["kind"] == "word", "name").otherwise(part["kind"])
        return _rendered(part, F.try_element_at(F.col("told"), F.concat_ws(" ", kind, part["canonical"])))

    def rewritten(pattern: str, matches: Column) -> Column:
        new = F.transform(matches, lambda parts: F.array_join(F.transform(parts, render), " "))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(F.split("text", pattern, -1).alias("gap"), new.alias("new")), lambda z: F.array(z["gap"], F.coalesce(z["new"], F.lit(""))))), "")

    words = F.transform(F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0)), _parts)
    text = F.when(F.array_contains(kinds, "person"), rewritten(ANY_WORD, words)).otherwise(rewritten(ANY, F.col("found")))

    def count(kind: str) -> Column:
        return F.size(F.filter(kinds, lambda x: x == kind)).cast("long")

    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(count, KINDS)))
    none = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(F.lit(0).cast("long") for _ in KINDS)))
    kept = [F.col(f"kept.{k}") for k in keep]
    changed = joined.select("doc_id", text.alias("text"), counts.alias("entities"), *kept)
    return changed.union(rows.where(~some).select("doc_id", "text", none.alias("entities"), *kept))


def digest(replaced: DataFrame) -> DataFrame:
    """The replaced texts with a count column per kind."""
    return replaced.select("doc_id", "text", *(F.col("entities")[k].alias(f"n_{k}") for k in KINDS))
