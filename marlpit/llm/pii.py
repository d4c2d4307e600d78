"""Keyed surrogates for personal data, in DataFrame functions only.

Entities found: e-mail addresses, IPv4 addresses, telephone numbers, payment card
numbers, secrets (named tokens and long hexadecimal strings), IBANs, US social
security numbers, and names after a gendered title. Every distinct entity of the
whole input gets one surrogate of its own type:

- an address keeps its shape (an e-mail stays an e-mail in a reserved domain, an
  IPv4 address four octets in a block kept for private use);
- digits are replaced by digits, letters by letters of their case, in the same
  positions with the same separators; card numbers keep their check digit valid
  if it was;
- a name is replaced by one of the title's gender and of the script of the name,
  the title kept; the same family name, alone or after a given name, gets the same
  family name.

Surrogates are drawn from SHA-256 of a secret key, the entity and an attempt
number. All distinct entities are then checked against each other and against
the originals: where two draws collide, the entity that sorts first keeps it and
the others draw again, until none collide; so distinct entities stay distinct
and equal ones equal, in any document. Entities are compared as canonical values
(e-mails and hexadecimal in lower case, numbers without separators), and every
spelling of one value is written in that spelling's own format.

An entity in very many documents is joined back in SALTS pieces; a document
without entities is never shuffled. Only names after a title are found. After
MOST_ATTEMPTS draws names and numbers grow longer, so there are always enough of
them. Null texts stay null, empty ones empty. Texts may be of any length. Rows
without an id are told apart by their texts.
Repeated rows give repeated results. Other columns keep their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: An entity with more than one in HOT_SHARE of all places, and more than LEAST_HOT, is spread over SALTS pieces.
HOT_SHARE, LEAST_HOT, SALTS = 2000, 1000, 256
#: Draws after which surrogates grow longer.
MOST_ATTEMPTS = 12

# What each type looks like. Order decides where two could start together. A repeated group costs Java's
# matcher stack for every round, so all have a bound; a host name has 127 labels at most.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]{0,63}[\p{L}\p{N}_%+\-]@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+){0,125}\.[A-Za-z]{2,}",
    "secret": r"\b[0-9a-fA-F]{32,}\b|\b(?:sk|pk|ghp|xoxb|AKIA)[_\-]?[A-Za-z0-9]{16,}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.])(?:\d{4}[ \-]?){3}\d{4}(?![\d.]\d|\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\d+.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-]|\.\d)",
    "he": r"\b(?:Mr|Herr|Monsieur|Señor|Sr|Mister)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
    "she": r"\b(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
# Titles, given names by gender and script, and family names by script.
TITLE = r"^(?:Mr|Herr|Monsieur|Señor|Sr|Mister|Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra)\.? "
GIVEN = {
    ("he", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("she", "latin"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("he", "cyrillic"): ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("she", "cyrillic"): ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения"],
    ("he", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης"],
    ("she", "greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα"],
}
SYLLABLES = {"latin": "ba da fa ga ka la ma na ra sa ta va be de le me ne re se te".split(), "cyrillic": "ба да га ка ла ма на ра са та ва бе де ле ме не ре се те зе".split(), "greek": "βα δα γα κα λα μα να ρα σα τα".split()}
TYPES = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# A cheap necessary sign of any of the patterns; most documents fail it.
SIGN = r"@|[0-9a-fA-F]{32}|\+[0-9]|[0-9][0-9.() \-]{6}|\b[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|\b(?:sk|pk|ghp|xoxb|AKIA)|\b(?:M(?:r|rs|s|iss|ister|me|adame|onsieur)|Herr|Frau|Se(?:ñ)ora?|Sra?)\b"


def kind_of(entity: Column) -> Column:
    """The first type whose pattern is the whole entity."""
    found = F.lit(TYPES[-1])
    for name in reversed(TYPES[:-1]):
        found = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(found)
    return found


def canonical(kind: Column, entity: Column) -> Column:
    """What two spellings of one entity have in common."""
    return (
        F.when(kind.isin("email", "secret"), F.lower(entity))
        .when(kind.isin("iban", "card", "ssn", "phone"), F.regexp_replace(entity, r"[ .()\-]", ""))
        .when(kind.isin("he", "she"), F.regexp_replace(entity, TITLE, ""))
        .otherwise(entity)
    )


def _number(digest: Column, start: int, size: int = 7) -> Column:
    return F.conv(F.substring(digest, start, size), 16, 10).cast("long")


def _pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % F.lit(len(words))).cast("int") + F.lit(1))


def _letters(value: Column, digest: Column) -> Column:
    """Digits for digits and letters for letters of their case; hexadecimal stays hexadecimal."""
    wide = F.concat(digest, F.sha2(digest, 256))
    marks = F.filter(F.split(value, ""), lambda c: c != "")

    def swapped(letters: str) -> Column:
        def swap(c: Column, k: Column) -> Column:
            n = F.conv(F.substr(wide, (k * F.lit(2)) % F.lit(126) + F.lit(1), F.lit(2)), 16, 10).cast("int")
            low = F.substr(F.lit(letters), n % F.lit(len(letters)) + F.lit(1), F.lit(1))
            return F.when(c.rlike("[0-9]"), F.substr(F.lit("0123456789"), n % F.lit(10) + F.lit(1), F.lit(1))).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low)).otherwise(c)

        return F.array_join(F.transform(marks, swap), "")

    # What a lambda names of the whole value is worked out for each of its characters, so the value is looked at here.
    return F.when(value.rlike("^[0-9a-f]+$"), swapped("abcdef")).otherwise(swapped("abcdefghijklmnopqrstuvwxyz"))


def _check_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    size = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), size), lambda k: F.substr(digits, k, F.lit(1)).try_cast("int") * F.when((size - k) % F.lit(2) == 1, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda total, x: total + F.when(x > 9, x - F.lit(9)).otherwise(x)) % F.lit(10)


def draw(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The canonical surrogate of a canonical value at one attempt."""
    digest = F.sha2(F.concat_ws("\u0000", F.lit(key), kind, value, attempt.cast("string")).cast("binary"), 256)
    tail = F.when(attempt >= MOST_ATTEMPTS, F.concat(F.lit("x"), digest)).otherwise(F.lit(""))
    email = F.concat(F.lit("user"), F.lower(F.conv(F.substring(digest, 1, 12), 16, 36)), tail, F.lit("@"), F.lit("example.invalid"))
    octets = F.concat_ws(".", F.lit("10"), *[(_number(digest, s, 2)).cast("string") for s in (1, 3, 5)])
    # Past the private block's size an address draws from 240.0.0.0/4, which no host uses.
    far = F.concat_ws(".", (_number(digest, 7, 1) + F.lit(240)).cast("string"), *[(_number(digest, s, 2)).cast("string") for s in (1, 3, 5)])
    swapped = _letters(value, digest)
    body = F.substring(swapped, 1, 15)
    check = (F.lit(10) - _check_sum(F.concat(body, F.lit("0")))) % F.lit(10)
    valid = _check_sum(value) == 0
    card = F.when(valid, F.concat(body, check.cast("string"))).otherwise(swapped)
    iban = F.concat(F.substring(value, 1, 2), F.substr(swapped, F.lit(3)))
    phone = F.when(value.startswith("+"), F.concat(F.lit("+"), F.substr(value, F.lit(2), F.lit(1)), F.substr(swapped, F.lit(3)))).otherwise(swapped)
    name = family = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        of_script = value.rlike(r"^\p{IsCyrillic}") if script == "cyrillic" else value.rlike(r"^\p{IsGreek}") if script == "greek" else ~value.rlike(r"^[\p{IsCyrillic}\p{IsGreek}]")
        spoken = lambda starts: F.concat(*[_pick(SYLLABLES[script], _number(digest, s, 4)) for s in starts])  # noqa: E731,B023
        # Past MOST_ATTEMPTS draws names grow, so there are always enough of them.
        given = F.concat(_pick(names, _number(digest, 1)), F.when(attempt >= MOST_ATTEMPTS, spoken((24, 28, 32, 36))).otherwise(""))
        of_family = F.initcap(F.concat(spoken((8, 12, 16, 20)), F.when(attempt >= MOST_ATTEMPTS, spoken((24, 28, 32, 36))).otherwise("")))
        name = F.coalesce(name, F.when((kind == gender) & of_script, given))
        family = F.coalesce(family, F.when((kind == "family") & of_script, of_family))
    longer = F.when(attempt >= MOST_ATTEMPTS, F.translate(F.substring(digest, 40, 6), "abcdef", "012345")).otherwise("")
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", F.when(attempt < 3, octets).otherwise(far))
        .when(kind == "card", F.concat(card, longer))
        .when(kind == "iban", F.concat(iban, longer))
        .when(kind == "phone", F.concat(phone, longer))
        .when(kind.isin("he", "she"), name)
        .when(kind == "family", family)
        .otherwise(F.concat(swapped, longer))
    )


def in_format(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The canonical surrogate written as the entity was: its separators, its title, its case."""
    marks = F.filter(F.split(entity, ""), lambda c: c != "")
    used = F.transform(marks, lambda c: F.when(c.rlike(r"[ .()\-]"), 0).otherwise(1))
    spread = F.array_join(
        F.transform(marks, lambda c, k: F.when(c.rlike(r"[ .()\-]"), c).otherwise(F.substr(surrogate, F.aggregate(F.slice(used, F.lit(1), k + F.lit(1)), F.lit(0), lambda a, b: a + b), F.lit(1)))), ""
    )
    return (
        F.when(kind.isin("iban", "card", "ssn", "phone"), F.concat(spread, F.substr(surrogate, F.aggregate(used, F.lit(1), lambda a, b: a + b), F.length(surrogate))))
        .when(kind.isin("he", "she"), F.concat(F.regexp_extract(entity, TITLE, 0), surrogate))
        .when((kind == "secret") & (entity == F.upper(entity)), F.upper(surrogate))
        .otherwise(surrogate)
    )


def settled(asked: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value, scope): no two alike within a kind and scope, none an original value of its kind. Those that clash draw again until none does."""
    kind, value = F.col("kind"), F.col("value")
    # A given name is drawn for a whole name, and must not be the one that stands there.
    own = F.when(kind.isin("he", "she"), F.substring_index(value, " ", 1)).otherwise(F.lit(None).cast("string"))
    originals = asked.where(~kind.isin("he", "she")).select("kind", value.alias("surrogate"))
    drawn = cut(asked.select("kind", "value", "scope", F.lit(0).alias("attempt"), draw(kind, value, key, F.lit(0)).alias("surrogate")))
    while True:
        taken = drawn.join(originals, ["kind", "surrogate"], "left_semi").select("kind", "value", F.lit(True).alias("taken"))
        shared = F.when(kind.isin("he", "she"), F.lit("given")).otherwise(kind)
        first = F.row_number().over(Window.partitionBy(shared, "scope", "surrogate").orderBy("attempt", "kind", "value"))
        ranked = drawn.withColumn("place", first).join(taken, ["kind", "value"], "left")
        clashes = (F.col("place") > 1) | F.coalesce(F.col("taken"), F.lit(False)) | F.coalesce(F.col("surrogate") == own, F.lit(False))
        ranked = cut(ranked.select("kind", "value", "scope", "attempt", "surrogate", clashes.alias("clashes")))
        if ranked.where("clashes").isEmpty():
            return ranked.select("kind", "value", "surrogate")
        again = F.col("attempt") + 1
        drawn = cut(ranked.select("kind", "value", "scope", F.when(F.col("clashes"), again).otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("clashes"), draw(kind, value, key, again)).otherwise(F.col("surrogate")).alias("surrogate")))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): no two alike within a type, none an original value of it.

    A family name has one surrogate wherever it stands, alone or after a given name, for either gender; within a family every given name has its own.
    """
    is_name, value = F.col("kind").isin("he", "she"), F.col("value")
    last = F.element_at(F.split(value, " "), -1)
    people = entities.where(is_name).select("kind", "value", last.alias("last"))
    families = people.select(F.lit("family").alias("kind"), F.col("last").alias("value"), F.lit("").alias("scope")).distinct()
    full = people.where(value.contains(" ")).select("kind", "value", F.col("last").alias("scope"))
    done = settled(entities.where(~is_name).select("kind", "value", F.lit("").alias("scope")).unionByName(families).unionByName(full), key)
    of_family = done.where("kind = 'family'").select(value.alias("last"), F.col("surrogate").alias("family"))
    named = people.join(of_family, "last").join(done.select("kind", "value", F.col("surrogate").alias("given")), ["kind", "value"], "left")
    names = named.select("kind", "value", F.concat_ws(" ", F.when(value.contains(" "), F.col("given")), "family").alias("surrogate"))
    return done.where(~F.col("kind").isin("he", "she", "family")).unionByName(names)


def find_entities(text: Column) -> Column:
    return F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ANY), 0))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and n_entities, the number of replaced places, as the last column. key: the secret that surrogates are drawn with."""
    text = F.col(text_col)
    # Rows without an id are told apart by their texts.
    ident = F.coalesce(F.concat(F.lit("id "), F.col(id_col).cast("string")), F.concat(F.lit("text "), F.sha2(text.cast("binary"), 256)))
    found = docs.withColumn("entities ", find_entities(text))
    some = F.coalesce(F.size("entities "), F.lit(0)) > 0
    seen = found.where(some).select(ident.alias("id "), F.explode(F.array_distinct("entities ")).alias("entity")).distinct()
    typed = cut(seen.withColumn("kind", kind_of(F.col("entity"))).withColumn("value", canonical(F.col("kind"), F.col("entity"))))
    counts = cut(typed.groupBy("kind", "value").agg(F.count("*").alias("many")))
    table = surrogates(counts.select("kind", "value"), key)
    # At most HOT_SHARE entities have so large a share of all places, so they may be broadcast.
    least = max(LEAST_HOT, typed.count() // HOT_SHARE)
    hot = counts.where(F.col("many") > least).select("kind", "value", F.lit(SALTS).alias("salts"))
    salted = table.join(F.broadcast(hot), ["kind", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    dealt = typed.join(F.broadcast(hot), ["kind", "value"], "left").withColumn("salt", F.pmod(F.hash("id "), F.coalesce("salts", F.lit(1)))).drop("salts")
    written = in_format(F.col("kind"), F.col("entity"), F.col("surrogate"))
    pairs = dealt.join(salted, ["kind", "value", "salt"]).select("id ", F.struct("entity", written.alias("written")).alias("pair"))
    maps = pairs.groupBy("id ").agg(F.map_from_entries(F.collect_list("pair")).alias("map "))
    rewritten = found.where(some).join(maps, ident == F.col("id "))
    # A text is what lies between its entities, and the entities, in turn.
    between = F.split(text, ANY, -1)
    turned = F.transform("entities ", lambda e: F.col("map ")[e])
    new = F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size("entities ")), turned, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    columns = docs.columns
    done = rewritten.select(*[(new.alias(text_col) if c == text_col else F.col(f"`{c}`")) for c in columns], F.size("entities ").cast("long").alias("n_entities"))
    rest = found.where(~some).select(*[f"`{c}`" for c in columns], F.lit(0).cast("long").alias("n_entities"))
    return done.unionByName(rest)
