"""Keyed surrogates for personal data and secrets, with DataFrame functions only.

One pattern finds e-mail and IP addresses, telephone, card, bank account and identity
numbers, access keys, the values of passwords and tokens, and names after a title. An
entity is replaced by a pure function of a secret key, its kind and its text, so equal
entities get equal surrogates everywhere without a lookup. The surrogate keeps the
kind and the written form: digits stay digits, separators and case stay, a card keeps
its first digit and its check digit rule, an address keeps its top-level domain under a
reserved name, a name keeps gender by its title, script and number of parts. Cards,
telephone numbers and bank accounts are keyed by their bare digits and letters, so one
number in two layouts gets one surrogate, in the layout of each mention.

Two entities could get one surrogate, or a surrogate could be another entity of the
corpus. All distinct entities are checked for that, and those that collide move to
their next attempt until none does. From attempt ``LONGER`` on secrets, telephone
numbers and addresses get a longer surrogate, as their shape may have no free one left.
Only entities with a later attempt, which are few, are joined back to their documents,
spread by document.

Edge cases: a null text stays null and an empty one empty; documents keep their rows,
repeated or not, and their other columns; entities are equal if their text is, but
e-mail addresses without regard to case and numbers without regard to separators; one
sign repeated, as in an empty field or an underline, is no secret, other secrets of
signs alone become letters; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = "documented default key; pass a secret one"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
TITLES_MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr")
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra")
TITLES_ANY = ("Dr", "Prof")
TITLES = "|".join(sorted(TITLES_MALE + TITLES_FEMALE + TITLES_ANY, key=len, reverse=True))
NAME = r"\p{Lu}[\p{L}'’-]+"
#: In order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*\.\p{L}{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    # The short look behind rules out nearly all places before the long one is tried.
    "secret": r"(?<=[=:][\s\"']{0,4})(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|api-key)\s{0,3}[=:]\s{0,3}[\"']?)(?!(?<sign>[+/_.~-])\k<sign>*+(?![A-Za-z0-9+/_.~-]))[A-Za-z0-9+/_.~-]{6,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "identity": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{TITLES})\.? {NAME}(?: {NAME})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Country code of a number without separators: no code begins another one.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: From this attempt on a surrogate may be longer than its entity.
LONGER = 3
#: Every entity has one of these; texts without any are not searched further.
HINT = rf"[0-9@=:]|A[KS]IA|(?:{TITLES})\.? \p{{Lu}}"

# Common given and family names by gender and script, for surrogates.
GIVEN = {
    ("male", "latin"): ["James", "Robert", "Daniel", "Thomas", "Paul", "Martin", "Lucas", "Andreas", "Hugo", "Mateo"],
    ("female", "latin"): ["Mary", "Laura", "Anna", "Julia", "Emma", "Clara", "Sofia", "Elena", "Marie", "Lucia"],
    ("any", "latin"): ["Alex", "Robin", "Kim", "Sam", "Jordan", "Morgan", "Taylor", "Casey", "Charlie", "Noa"],
    ("male", "cyrillic"): ["Иван", "Пётр", "Павел", "Андрей", "Николай", "Сергей"],
    ("female", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Татьяна"],
    ("any", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
}
FAMILY = {
    "latin": ["Smith", "Brown", "Martin", "Weber", "Garcia", "Moreau", "Fischer", "Lopez", "Bernard", "Walker", "Keller", "Dubois"],
    "cyrillic": ["Иванов", "Петров", "Волков", "Смирнов", "Орлов", "Соколов"],
}


def kind_of(value: Column) -> Column:
    """Kind of a found entity from its text alone."""
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(value.rlike("^[^@\\s]+@[^@\\s]+$"), "email")
        .when(value.rlike(rf"^(?:{TITLES})\.? \p{{Lu}}"), "name")
        .when(value.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"), "access_key")
        .when(value.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "identity")
        .when(value.rlike(r"^\d[\d -]{11,}\d$") & digits.between(13, 19), "card")
        .when(value.rlike(r"^\+?[\d(][\d() .-]+$") & digits.between(7, 18), "phone")
        .when(value.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{12,}$"), "iban")
        .otherwise("secret")
    )


def _bare(value: Column) -> Column:
    """A number without its separators."""
    return F.regexp_replace(value, "[^0-9A-Z+]", "")


def _same(kind: Column, value: Column) -> Column:
    """What has to be equal for two mentions to be one entity."""
    # A key must be of its value's kind: a long number without "+" and separators would be a card.
    long = (kind == "phone") & ~value.startswith("+") & (F.length(_bare(value)) > 12)
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("card", "phone", "iban") & ~long, _bare(value)).otherwise(value)
    )


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts), 512)


def _byte(digest: Column, i: Column) -> Column:
    """Byte of a digest for position ``i``; positions repeat after 64."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, digest: Column, keep: int = 0) -> Column:
    """Digits for digits, letters for letters of the same case; the rest as it is."""
    pick = lambda alphabet, i: F.substr(F.lit(alphabet), _byte(digest, i) % len(alphabet) + 1, F.lit(1))
    one = lambda c, i: (
        F.when(i < keep, c)
        .when(c.rlike("[0-9]"), pick("0123456789", i))
        .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
        .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i))
        .when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", i))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _laid_out(value: Column, bare: Column) -> Column:
    """Characters of ``bare`` one after the other where ``value`` has no separator."""
    nth = lambda i: F.length(_bare(F.substr(value, F.lit(1), i + 1)))
    one = lambda b: lambda c, i: F.when(c.rlike("[0-9A-Z+]"), F.substr(b, nth(i), F.lit(1))).otherwise(c)
    return _once(bare, lambda b: F.array_join(F.transform(F.split(value, ""), one(b)), ""))


def _luhn(digits: Column) -> Column:
    """Sum of the check digit rule over a string of digits, from the right."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))


def _card(digits: Column, digest: Column) -> Column:
    def checked(shaped: Column) -> Column:
        body = F.substr(shaped, F.lit(1), F.length(shaped) - 1)
        check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        return F.when(_luhn(digits) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(shaped)

    return _once(_shaped(digits, digest, keep=1), checked)


def _name(value: Column, digest: Column) -> Column:
    """Title kept; given and family name of the title's gender and the name's script."""
    title = F.regexp_extract(value, rf"^({TITLES})\.? ", 0)
    bare = F.regexp_extract(value, rf"^({TITLES})", 1)
    script = F.when(value.rlike(r" \p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(bare.isin(*TITLES_MALE), "male").when(bare.isin(*TITLES_FEMALE), "female").otherwise("any")
    from_list = lambda names, at: F.element_at(F.array(*map(F.lit, names)), _byte(digest, F.lit(at)) % len(names) + 1)
    given = reduce(
        lambda rest, g: F.when((gender == g[0]) & (script == g[1]), from_list(GIVEN[g], 0)).otherwise(rest), GIVEN, F.lit("")
    )
    family = F.when(script == "cyrillic", from_list(FAMILY["cyrillic"], 1)).otherwise(from_list(FAMILY["latin"], 1))
    # A second, generated part keeps names apart when the lists are exhausted.
    extra = F.initcap(_shaped(F.when(script == "cyrillic", F.lit("аааа")).otherwise(F.lit("aaaa")), F.substr(digest, F.lit(9), F.lit(120))))
    two = value.rlike(rf"^(?:{TITLES})\.? {NAME} ")
    return F.concat(title, F.when(two, F.concat(given, F.lit(" "))).otherwise(F.lit("")), family, F.lower(extra))


def _once(expression: Column, use: Callable[[Column], Column]) -> Column:
    """``use(expression)`` with the expression evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(expression), use), 1)


def surrogate(value: Column, attempt: Column, key: str) -> Column:
    """Replacement of an entity at a given attempt; its kind comes from its text."""
    known = F.struct(value.alias("value"), attempt.alias("attempt"), kind_of(value).alias("kind"), _bare(value).alias("bare"))
    digest = lambda k: _digest(F.lit(key), k["kind"], _same(k["kind"], k["value"]), k["attempt"].cast("string"))
    return _once(known, lambda k: _once(digest(k), lambda d: _replacement(k["value"], k["attempt"], k["kind"], k["bare"], d, key)))


def _replacement(value: Column, attempt: Column, kind: Column, bare: Column, digest: Column, key: str) -> Column:
    longer = lambda shape: F.when(attempt >= LONGER, _shaped(F.lit(shape), F.substr(digest, F.lit(9), F.lit(120)))).otherwise("")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    host = _digest(F.lit(key), F.lit("domain"), F.lower(domain))
    email = F.concat(
        _shaped(F.lower(local), digest), longer("a" * 12), F.lit("@h"), F.substr(host, F.lit(1), F.lit(10)), F.lit(".example."), F.lower(F.substring_index(domain, ".", -1))
    )
    ip = F.concat_ws(".", (_byte(digest, F.lit(0)) % 15 + 240).cast("string"), *[_byte(digest, F.lit(i)).cast("string") for i in (1, 2, 3)])
    code = F.length(F.regexp_extract(bare, COUNTRY, 0))
    phone = F.concat(F.substr(bare, F.lit(1), code), _shaped(F.substr(bare, code + 1, F.length(bare)), digest))
    # Signs alone have nothing to vary.
    shape = F.when(value.rlike("[A-Za-z0-9]"), value).otherwise(F.regexp_replace(value, ".", "a"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", _laid_out(value, _card(bare, digest)))
        .when(kind == "phone", F.concat(_laid_out(value, phone), longer("0" * 12))).when(kind == "access_key", _shaped(value, digest, keep=4))
        .when(kind == "iban", _laid_out(value, _shaped(bare, digest, keep=2))).when(kind == "name", _name(value, digest))
        .when(kind == "identity", _shaped(value, digest)).otherwise(F.concat(_shaped(shape, digest), longer("a" * 12)))
    )


def mentions(docs: DataFrame) -> DataFrame:
    """Rows that may hold entities, with ``_found``: their mentions in text order."""
    found = F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), 0), F.array().cast("array<string>"))
    return docs.where(F.col("text").rlike(HINT)).withColumn("_found", found)


def entities(found: DataFrame) -> DataFrame:
    """Every distinct entity among :func:`mentions`: ``value``."""
    each = found.select(F.explode(F.array_distinct("_found")).alias("value"))
    return each.distinct().select(_same(kind_of(F.col("value")), F.col("value")).alias("value")).distinct()


def later_attempts(found: DataFrame, key: str = KEY) -> DataFrame:
    """``value, attempt`` of the entities whose first surrogate collides."""
    now = stored(found.select("value", F.lit(0).alias("attempt"), surrogate(F.col("value"), F.lit(0), key).alias("made")), "surrogates")
    while True:
        keeper = now.groupBy("made").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = now.join(keeper, "made")
        original = found.select(F.col("value").alias("made")).withColumn("is_entity", F.lit(True))
        bad = taken.join(original, "made", "left").withColumn(
            "again", F.coalesce("is_entity", F.lit(False)) | ((F.col("n") > 1) & (F.struct("attempt", "value") != F.col("first")))
        )
        moved = F.when(F.col("again"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        after = stored(
            bad.select("value", moved.alias("attempt"), "made", "again")
            .withColumn("made", F.when(F.col("again"), surrogate(F.col("value"), F.col("attempt"), key)).otherwise(F.col("made"))),
            "surrogates",
        )
        if not after.where("again").limit(1).count():
            return after.where("attempt > 0").select("value", "attempt")
        now = after.drop("again")


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities replaced in ``text``, and ``n_entities`` added."""
    held = stored(mentions(docs), "mentions")
    later = stored(later_attempts(stored(entities(held), "entities"), key), "later-attempts")
    plain = docs.where(~F.coalesce(F.col("text").rlike(HINT), F.lit(False))).withColumn("n_entities", F.lit(0).cast("bigint"))
    each = held.select("doc_id", F.explode(F.array_distinct("_found")).alias("mention"))
    each = each.withColumn("value", _same(kind_of(F.col("mention")), F.col("mention")))
    # A mention that fills a third of the corpus is spread over salts of its document.
    salts = 16
    spread = later.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    tries = (
        each.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).join(spread, ["value", "salt"])
        .groupBy("doc_id").agg(F.collect_set(F.struct("value", "attempt")).alias("_tries"))
    )
    some = held.join(tries, "doc_id", "left")
    attempts = F.map_from_entries(F.coalesce("_tries", F.array().cast("array<struct<value:string,attempt:int>>")))
    some = some.withColumn("_attempts", attempts)
    made = F.transform(
        "_found",
        lambda v: surrogate(v, F.coalesce(F.element_at("_attempts", _same(kind_of(v), v)), F.lit(0)), key),
    )
    some = some.withColumn("_made", made).withColumn("_parts", F.split("text", PATTERN, -1))
    text = F.array_join(F.transform("_parts", lambda p, i: F.concat(p, F.coalesce(F.get("_made", i), F.lit("")))), "")
    some = some.withColumns({"text": text, "n_entities": F.size("_found").cast("bigint")}).drop("_tries", "_attempts", "_made", "_parts", "_found")
    return plain.unionByName(some)


def report(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"))
