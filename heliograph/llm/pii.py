"""PII: detected entities receive keyed surrogates of the same type, gender, script and format.

Native: every step is a DataFrame expression.

*Units.*  What denotes one thing is one unit, whatever its spelling: mail addresses, names' words and
account numbers without regard to case and separators, so coreferent mentions stay coreferent.  A mail
address keeps its top-level domain, a phone number its country code, a card its first digit and its
Luhn standing, an account its country, a name its honorific; a listed given name moves within the list
of its gender and script; an address of four octets (spelt differently it is another entity) stays one.

*Surrogates.*  Each other letter or digit is replaced by one of its own alphabet, chosen by a hash of
key, attempt, unit and place: vowels, consonants and digits for the basic Latin, Greek and Cyrillic
letters, else the letters of that case within the same 128 code points, in any script.  The last letter
of a word, which tells the gender in many languages, stays where it is a basic vowel.

*Collision check.*  Attempts go on until every unit has a surrogate that is no unit of the corpus, no
listed name and nobody else's; from the fourth attempt on surrogates grow, so that none is left over.
Mentions then take their surrogates from this table by a join, and get back their case and separators.

*Cost.*  The patterns run over each text once; only rows with entities are shuffled.

Defined results.  A null text stays null and has no entities; an empty text stays empty.  Rows that
repeat are treated alike.  All other columns pass through untouched, under their own names; ``into``
names the column of entities, which the input must not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, fresh, written

# Honorifics and given names by script and gender.
MALE_TITLES = "Mr Herr Monsieur Señor Sr Signor Господин Κύριος".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Госпожа Κυρία".split()
GIVEN = {
    "latin_male": "Adam Alan Albert Andrew Anthony Arthur Brian Carl Charles Daniel David Edward Eric Frank George Hans Henry Jack James Jean John Joseph Karl Luis Mark Martin Michael Oliver Paul Peter Philip Pierre Richard Robert Samuel Simon Stephen Thomas Walter William".split(),
    "latin_female": "Alice Amanda Andrea Angela Anna Barbara Brigitte Carmen Caroline Catherine Charlotte Claire Diana Dorothy Elena Elizabeth Emily Emma Eva Helen Ingrid Isabel Jane Jennifer Julia Karen Laura Linda Lucia Margaret Maria Mary Nancy Patricia Rachel Ruth Sarah Sophie Susan Ursula".split(),
    "cyrillic_male": "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Сергей".split(),
    "cyrillic_female": "Анна Вера Галина Екатерина Елена Ирина Мария Наталья Ольга Татьяна".split(),
    "greek_male": "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
    "greek_female": "Άννα Βασιλική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα".split(),
}
#: Basic letters, kept apart as vowels and consonants; all other letters go by case and block.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь",
    "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬЫ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ",
)
_VOWELS = "[aeiouаеиоуыэюяαεηιουω]"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The part before @ has at most 64 characters, which also bounds what a failing match scans.
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IPV4 = rf"(?<![0-9]\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9\p{{L}}])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}])"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])"
_TITLE = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES) + r")\.?"
_LISTED = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"
#: A capitalised word, also with an apostrophe or hyphens, or a word of a script without case; titles don't count.
_WORD = rf"(?!{_TITLE} )(?:\p{{Lu}}(?:\p{{L}}++(?:['’-]\p{{L}}++)*+|['’]\p{{L}}++)|\p{{Lo}}\p{{L}}*+)"
NAME = rf"(?=\p{{Lu}})(?:{_TITLE}(?: {_WORD}){{1,2}}|{_LISTED} {_WORD})"
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:{EMAIL}|(?=[0-9+(])(?:{IPV4}|{SSN}|{CARD}|{PHONE})|{IBAN}|{NAME})"
KINDS = ("email", "ipv4", "ssn", "iban", "card", "phone", "name")


def kind_of(entity: Column) -> Column:
    like = lambda r: F.regexp_like(entity, F.lit(f"^(?:{r})$"))
    return (
        F.when(F.contains(entity, F.lit("@")), "email").when(like(IPV4), "ipv4").when(like(SSN), "ssn")
        .when(like(IBAN), "iban").when(like(PHONE), "phone").when(like(CARD), "card").otherwise("name")
    )


def entities(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>"))


# --- units ---

_PREFIX = r"^\+[0-9]{1,3}(?=[ .(-])"


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z]", "")


def _after(text: Column, head: Column) -> Column:
    return F.substring(text, F.length(head) + 1, F.length(text))


def spelt(surfaces: DataFrame) -> DataFrame:
    """entity, kind, head (what stays in front), given, unit: an entity's parts."""
    e = F.col("entity")
    parts = surfaces.withColumn("kind", kind_of(e))
    parts = parts.withColumn("head", F.when(F.col("kind") == "name", F.regexp_extract(e, rf"^{_TITLE} ", 0)).when(F.col("kind") == "phone", F.regexp_extract(e, _PREFIX, 0)).otherwise(F.lit("")))
    words = F.split(F.lower(_after(e, F.col("head"))), " ")
    unit = (
        F.when(F.col("kind") == "name", F.element_at(words, -1)).when(F.col("kind") == "email", F.lower(e)).when(F.col("kind") == "ipv4", e)
        .when(F.col("kind") == "phone", F.concat("head", F.lit(" "), _bare(_after(e, F.col("head"))))).otherwise(_bare(e))
    )
    return parts.select("entity", "kind", "head", F.when((F.col("kind") == "name") & (F.size(words) > 1), words[0]).alias("given"), unit.alias("unit"))


def _amount(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def _listed(word: Column, key: str) -> Column:
    """A listed given name's surrogate: a fixed number of places on in its list; null if it isn't listed."""
    out = F.lit(None).cast("string")
    for group, names in GIVEN.items():
        at = F.array_position(F.array(*(F.lit(n.lower()) for n in names)), word)
        moved = F.element_at(F.array(*map(F.lit, names)), (F.pmod(at + F.pmod(_amount(key, group), F.lit(len(names) - 1)), F.lit(len(names))) + 1).cast("int"))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def _alphabet(c: Column) -> Column:
    """The name of a letter's or digit's alphabet; null for all else."""
    basic = F.lit(None).cast("string")
    for k, letters in enumerate(ALPHABETS):
        basic = F.when(F.instr(F.lit(letters), c) > 0, F.lit(f"basic{k}")).otherwise(basic)
    kind = F.when(F.regexp_like(c, F.lit(r"^\p{Lu}$")), "Lu").when(F.regexp_like(c, F.lit(r"^\p{Ll}$")), "Ll").when(F.regexp_like(c, F.lit(r"^\p{L}$")), "Lo").when(F.regexp_like(c, F.lit(r"^\p{N}$")), "N")
    point = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint")
    return F.coalesce(basic, F.concat(kind, F.floor(point / 128).cast("string")))


def alphabets(spark: SparkSession) -> DataFrame:
    """alphabet, members; a letter that is alone in its alphabet borrows the basic consonants."""
    point = spark.range(0x30, 0x110000, 1, 8).where("id < 55296 or id > 57343")
    symbol = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = point.select(symbol.alias("symbol")).where(F.regexp_like("symbol", F.lit(r"^[\p{L}\p{N}]$"))).select("symbol", _alphabet(F.col("symbol")).alias("alphabet"))
    own = known.groupBy("alphabet").agg(F.array_sort(F.collect_list("symbol")).alias("members"))  # 128 at most
    spare = F.split(F.when(F.col("alphabet").startswith("Lu"), F.lit(ALPHABETS[4])).when(F.col("alphabet").startswith("N"), F.lit(ALPHABETS[0])).otherwise(F.lit(ALPHABETS[2])), "(?!^)")
    return own.select("alphabet", F.when(F.size("members") > 1, F.col("members")).otherwise(spare).alias("members"))


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` plus that digit pass the Luhn test."""
    digits = F.reverse(F.regexp_extract_all(body, F.lit("[0-9]"), F.lit(0)))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(10 - F.pmod(F.aggregate(worth, F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


GROWS = 3


def candidates(units: DataFrame, letters: DataFrame, key: str, attempt: int) -> DataFrame:
    """kind, unit, made: each unit's surrogate of this attempt."""
    ipv4 = F.col("kind") == "ipv4"
    first = F.when(F.col("kind") == "phone", F.length(F.regexp_extract("unit", "^[^ ]* ", 0))).when(F.col("kind") == "card", 1).when(F.col("kind") == "iban", 2).otherwise(0)
    last = F.when(F.col("kind") == "email", F.length(F.regexp_extract("unit", r"\.[^.@]*$", 0))).when((F.col("kind") == "name") & F.regexp_like("unit", F.lit(f".{_VOWELS}$")), 1).otherwise(0)
    symbols = F.when(ipv4, F.split("unit", r"\.")).otherwise(F.regexp_extract_all("unit", F.lit("(?s)."), F.lit(0)))
    spread = units.select("kind", "unit", first.alias("first"), last.alias("last"), symbols.alias("symbols")).select("kind", "unit", "first", (F.size("symbols") - F.col("last")).alias("end"), F.posexplode("symbols").alias("at", "symbol"))
    moves = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("end"))
    spread = spread.withColumn("alphabet", F.when(moves & ~ipv4, _alphabet(F.col("symbol")))).join(F.broadcast(letters), "alphabet", "left")
    extra = F.when(F.col("at") == F.col("first"), F.lit(max(0, attempt - GROWS + 1))).otherwise(F.lit(0))
    pick = lambda j: F.element_at("members", (F.pmod(_amount(key, str(attempt), F.col("kind"), F.col("unit"), F.col("at").cast("string"), j.cast("string")), F.size("members")) + 1).cast("int"))
    new = F.when(ipv4, F.pmod(_amount(key, str(attempt), F.col("kind"), F.col("unit"), F.col("at").cast("string")), F.lit(256)).cast("string"))
    new = new.when(F.col("members").isNotNull(), F.array_join(F.transform(F.sequence(F.lit(0), extra), pick), "")).otherwise(F.col("symbol"))
    made = spread.groupBy("kind", "unit").agg(F.array_sort(F.collect_list(F.struct("at", new.alias("new")))).alias("news"))
    joined = F.when(F.col("kind") == "ipv4", F.array_join("news.new", ".")).otherwise(F.array_join("news.new", ""))
    made = made.select("kind", "unit", joined.alias("made"))
    body = F.substring("made", F.lit(1), F.length("made") - 1)
    off = F.substring("unit", F.length("unit"), F.lit(1)).cast("int") - _luhn_digit(F.substring("unit", F.lit(1), F.length("unit") - 1))
    return made.withColumn("made", F.when(F.col("kind") == "card", F.concat(body, F.pmod(_luhn_digit(body) + off, F.lit(10)).cast("string"))).otherwise(F.col("made")))


def settled(units: DataFrame, key: str) -> DataFrame:
    """kind, unit, made: a surrogate for every unit, none of them a unit, a listed name or another's surrogate."""
    spark = units.sparkSession
    units, letters = checkpointed(units.select("kind", "unit").distinct()), checkpointed(alphabets(spark))
    names = F.explode(F.array(*(F.lit(n.lower()) for names in GIVEN.values() for n in names)))
    taken = units.select("kind", F.col("unit").alias("made")).unionByName(spark.range(1).select(F.lit("name").alias("kind"), names.alias("made")))
    left, waiting, done, attempt = units, units.count(), None, 0
    while waiting:
        tried = candidates(left, letters, key, attempt).join(taken, ["kind", "made"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("kind", "made"), ["kind", "made"], "left_anti")
        fits = checkpointed(tried.groupBy("kind", "made").agg(F.min("unit").alias("unit")).select("kind", "unit", "made"))
        done = fits if done is None else done.unionByName(fits)
        waiting -= fits.count()
        if waiting:
            left = checkpointed(left.join(fits.select("kind", "unit"), ["kind", "unit"], "left_anti"))
        attempt += 1
    return done if done is not None else candidates(units, letters, key, 0)


# --- mentions ---


def _cased(made: Column, like: Column) -> Column:
    """``made`` in the case of ``like``: letter by letter where both are as long, else of its first letter."""
    letter = lambda text, i: F.substring(text, i, F.lit(1))
    upper = lambda text: text != F.lower(text)
    each = F.array_join(F.transform(F.sequence(F.lit(1), F.length(made)), lambda i: F.when(upper(letter(like, i)), F.upper(letter(made, i))).otherwise(letter(made, i))), "")
    first = F.when(upper(F.substring(like, 1, 1)), F.concat(F.upper(F.substring(made, 1, 1)), _after(made, F.lit(" ")))).otherwise(made)
    return F.when(F.length(made) == F.length(like), each).otherwise(first)


def _filled(made: Column, like: Column) -> Column:
    """The characters of ``made`` in the places of those of ``like``, between its separators; what is over follows."""
    bare = lambda n: F.length(_bare(F.substring(like, F.lit(1), n)))
    place = lambda i: F.when(F.regexp_like(F.substring(like, i, F.lit(1)), F.lit("[0-9A-Za-z]")), F.substring(made, bare(i), F.lit(1))).otherwise(F.substring(like, i, F.lit(1)))
    over = F.substring(made, bare(F.length(like)) + 1, F.length(made))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), place), ""), over)


def surrogates(surfaces: DataFrame, key: str) -> DataFrame:
    """entity, kind, surrogate of the distinct entities in ``surfaces``."""
    parts = checkpointed(spelt(surfaces))
    parts = parts.withColumn("moved", _listed(F.col("given"), key))
    loose = F.col("given").isNotNull() & F.col("moved").isNull()
    made = checkpointed(settled(parts.select("kind", "unit").unionByName(parts.where(loose).select("kind", F.col("given").alias("unit"))), key))
    first = made.where("kind = 'name'").select(F.col("unit").alias("given"), F.col("made").alias("given_made"))
    known = parts.join(made, ["kind", "unit"]).join(first, "given", "left")
    rest = _after(F.col("entity"), F.col("head"))
    words = F.split(rest, " ")
    given = F.when(F.col("given").isNull(), F.lit("")).otherwise(F.concat(_cased(F.coalesce("moved", "given_made"), words[0]), F.lit(" ")))
    text = (
        F.when(F.col("kind") == "name", F.concat("head", given, _cased(F.col("made"), F.element_at(words, -1)))).when(F.col("kind") == "email", _cased(F.col("made"), F.col("entity")))
        .when(F.col("kind") == "ipv4", F.col("made")).when(F.col("kind") == "phone", F.concat("head", _filled(F.regexp_replace("made", "^[^ ]* ", ""), rest))).otherwise(_filled(F.col("made"), rest))
    )
    return known.select("entity", "kind", text.alias("surrogate"))


def redact(docs: DataFrame, key: str = "heliograph", text: str = "text", into: str = "pii") -> DataFrame:
    """The input's columns with ``text`` rewritten, and ``into``: array of struct(kind, entity, surrogate)."""
    if fresh(into, docs.columns) != into:
        raise ValueError(f"the input has a column {into} already")
    names = [*docs.columns, into]
    row, found, told = fresh("__row", names), fresh("__found", names), fresh("__told", names)
    base = written(docs.withColumn(found, entities(F.col(text))).withColumn(row, F.monotonically_increasing_id()))
    none = F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")
    clean = base.where(F.size(found) == 0).select(*(F.col(f"`{c}`") for c in docs.columns), none.alias(into))
    hit = base.where(F.size(found) > 0)
    mentions = hit.select(F.col(row).alias("row"), F.explode(F.array_distinct(F.col(found))).alias("entity"))
    table = checkpointed(surrogates(mentions.select("entity").distinct(), key))
    answers = mentions.join(table, "entity").groupBy("row").agg(F.collect_list(F.struct("entity", F.struct("kind", "entity", "surrogate").alias("pair"))).alias("pairs"))
    answers = answers.select(F.col("row").alias(row), F.map_from_entries("pairs").alias(told))
    pairs = F.transform(F.col(found), lambda e: F.try_element_at(F.col(told), e))
    gaps = F.split(F.col(text), ENTITY, -1)
    rewritten = F.array_join(F.zip_with(gaps, F.array_append(F.col(into)["surrogate"], F.lit("")), lambda g, s: F.concat(g, s)), "")
    return hit.join(answers, row).withColumn(into, pairs).withColumn(text, rewritten).select(*(F.col(f"`{c}`") for c in names)).unionByName(clean)


def report(docs: DataFrame, key: str = "heliograph") -> DataFrame:
    """doc_id, the counts by kind, and the rewritten text."""
    of = lambda k: F.size(F.filter("pii", lambda p: p["kind"] == k)).cast("long").alias(f"n_{k}")
    return redact(docs.select("doc_id", "text"), key).select("doc_id", F.size("pii").cast("long").alias("n_entities"), *map(of, KINDS), "text")
