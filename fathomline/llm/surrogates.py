"""Surrogates for personal data, in DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, phone, card, bank and social-security numbers, hex secrets and
titled names. Each entity is brought to a normal form (so that spellings of one entity corefer), and a hash under a
secret key, its type and its normal form chooses a replacement of the same type: digits for digits in the same
layout, a valid card number for a valid one, octets for octets, hex for hex, letters in the same case and script. A
name keeps its title; its family name is replaced alike under every title, and a given name by one of the title's
gender and the name's script. The same entity gets the same replacement in every document.

Collision check: replacements of all distinct entities are compared with each other and with the entities themselves;
those that clash (all but one of each clash: fewest draws, then smallest sealed form) are drawn again until none is
left, so distinct entities stay distinct. Only documents with a redrawn entity meet the table of redraws.

Stored tables hold entities and replacements sealed only: encrypted under the secret key, the same way each time, so
that sealed forms can be compared. They are deleted once nothing reads them; what stays for the rewriting has the
sealed form and the count of draws of redrawn entities, nothing that a replacement could be undone by.

Null texts stay null; empty texts and texts without entities are unchanged. Repeated rows change alike. Very long texts are searched whole, once for the table of
entities and once for the rewriting. An empty table gives an empty result. Columns keep their names and values whatever
these are, save for the text and the count that is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, stored

#: The secret of the query and the pipeline: the setting KEY_SETTING of the session, else a key for tests.
KEY_SETTING = "spark.fathomline.surrogates.key"
TEST_KEY = "not-a-secret"
#: Documents with redrawn entities that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rounds without fewer clashes than ever before, after which a type's space counts as full.
STUCK = 20

#: The patterns of entities, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .!-]{0,3}\(?\d{1,4}\)?(?:[ .!-]{0,3}\d{2,4}){2,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Mlle|Господин|Госпожа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Titles by gender, and given names by gender and script.
FEMALE = "^(Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mlle|Госпожа)"
MALE = "^(Mr|Herr|Señor|Sr|Monsieur|Господин)"
GIVEN = {
    ("f", "latin"): "Anna Clara Diana Elena Greta Helen Irene Julia Laura Maria Nora Olga Paula Rita Sara Vera".split(),
    ("m", "latin"): "Adam Boris Carl David Emil Frank Georg Hugo Ivan Jonas Karl Leo Martin Oscar Paul Victor".split(),
    ("n", "latin"): "Alex Andrea Chris Dominique Eden Jules Kim Lee Luca Morgan Noa Robin Sacha Sam Toni Yael".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Раиса София".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Степан".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Никита Паша Вася Дана Тоня Мила Витя Лёша Рома Даня Юля".split(),
}
SYLLABLES = {
    "latin": "ba den for gel hal kin lor mar nes pol rin sal tor ven wal zer".split(),
    "cyrillic": "ба ден фор гел хал кин лор мар нес пол рин сал тор вен вал зер".split(),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def type_of(entity: Column) -> Column:
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(entity.rlike(r"^[0-9A-Fa-f]{32,}$") & entity.rlike("[A-Fa-f]"), "secret")
        .when(entity.rlike(r"^[+(]"), "phone")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(entity.rlike(r"^\p{L}"), "name")
        .when(digits >= 13, "card")
        .otherwise("phone")
    )


def normal(kind: Column, entity: Column) -> Column:
    """One spelling for each entity."""
    return F.when(kind.isin("email", "secret"), F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "))).when(kind.isin("card", "ssn", "phone"), F.regexp_replace(entity, r"\D", "")).otherwise(entity)


def title_of(entity: Column) -> Column:
    return F.regexp_extract(entity, r"^\S+ ", 0)


def identities(entity: Column) -> Column:
    """array of struct(kind, norm): of a name its given name, if there is one, and its family name, each an identity of
    its own, so that "Mr. Miller" and "Dr. John Miller" share the family name; of others one."""

    def of_name(words: Column) -> Column:
        gender = F.when(entity.rlike(FEMALE), "given f").when(entity.rlike(MALE), "given m").otherwise("given n")
        return F.transform(words, lambda w, i: F.struct(F.when(i + 1 < F.size(words), gender).otherwise("family").alias("kind"), w.alias("norm")))

    def of(kind: Column) -> Column:
        return F.when(kind == "name", let(F.split(F.substring(entity, F.length(title_of(entity)) + 1, F.length(entity)), " "), of_name)).otherwise(F.array(F.struct(kind.alias("kind"), normal(kind, entity).alias("norm"))))

    return let(type_of(entity), of)


def luhn(digits: Column, parity: int) -> Column:
    """The Luhn sum of digits, where those at odd (0) or even (1) places from the right count twice over."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * F.when(i % 2 == parity, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))), F.lit(0), lambda a, d: a + d
    )


def spread(entity: Column, digest: Column) -> Column:
    """Letters and digits of entity replaced, each by its kind, in place."""
    figures = F.translate(digest, "abcdef", "012345")
    letters = F.translate(digest, "0123456789abcdef", "ghijklmnopqrstuv")

    def swapped(c: Column, i: Column) -> Column:
        at = i % 64 + 1
        return F.when(c.rlike("[0-9]"), F.substring(figures, at, F.lit(1))).when(c.rlike("[a-z]"), F.substring(letters, at, F.lit(1))).when(c.rlike("[A-Z]"), F.upper(F.substring(letters, at, F.lit(1)))).otherwise(c)

    return F.array_join(F.transform(F.split(entity, ""), swapped), "")


def number(digest: Column, at: int) -> Column:
    """The at-th 28-bit number of a hex digest."""
    return F.conv(F.substring(digest, at * 7 + 1, 7), 16, 10).cast("int")


def pick(words: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.pmod(n, F.lit(len(words))) + 1)


def picked(words: list[str], digest: Column) -> Callable[[Column], Column]:
    return lambda i: pick(words, F.conv(F.substring(digest, (i * 7 + 1).cast("int"), F.lit(7)), 16, 10).cast("int"))


def name_like(kind: Column, norm: Column, digest: Column, attempt: Column) -> Column:
    """A family name of syllables, or a given name by gender, both of the name's script. Later attempts are longer:
    more syllables, double given names."""
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given, family = F.lit(None), F.lit(None)
    for (sex, letters), words in GIVEN.items():
        parts = F.transform(F.sequence(F.lit(0), F.least(attempt, F.lit(6))), picked(words, digest))
        given = F.when((kind == f"given {sex}") & (script == letters), F.array_join(parts, "-")).otherwise(given)
    for letters, parts in SYLLABLES.items():
        longer = F.when(attempt > 2, F.concat(*(pick(parts, number(digest, i)) for i in range(5, 8)))).otherwise("")
        family = F.when(script == letters, F.initcap(F.concat(*(pick(parts, number(digest, i)) for i in range(1, 5)), longer))).otherwise(family)
    return F.when(kind == "family", family).otherwise(given)


def draw(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The replacement's normal form."""

    def of(digest: Column) -> Column:
        figures = F.translate(digest, "abcdef", "012345")
        short = F.concat(F.left(norm, F.lit(1)), F.substring(figures, F.lit(2), F.length(norm) - 2))
        valid = F.pmod(luhn(norm, 1), F.lit(10)) == 0
        check = F.pmod(-luhn(short, 0), F.lit(10)).cast("string")
        card = F.concat(short, F.when(valid, check).otherwise(F.substring(figures, 60, 1)))
        octets = F.concat_ws(".", *((F.pmod(number(digest, i), F.lit(223 if i == 0 else 254)) + 1).cast("string") for i in range(4)))
        mail = F.concat(spread(F.substring_index(norm, "@", 1), digest), F.lit("@"), spread(F.regexp_extract(norm, r"@([^.]+)", 1), F.reverse(digest)), F.lit(".example."), pick(["com", "net", "org"], number(digest, 5)))
        return (
            F.when(kind == "email", mail)
            .when(kind == "ip", octets)
            .when(kind == "secret", F.left(F.repeat(digest, 2), F.length(norm)))
            .when(kind == "card", card)
            .when(kind == "phone", F.concat(F.left(norm, F.lit(1)), F.substring(figures, F.lit(2), F.length(norm) - 1)))
            .when(kind == "ssn", F.left(figures, F.lit(9)))
            .when(kind == "iban", F.concat(F.left(norm, F.lit(2)), spread(F.substring(norm, F.lit(3), F.length(norm)), digest)))
            .otherwise(name_like(kind, norm, digest, attempt))
        )

    return let(F.sha2(F.concat_ws("\u0000", F.lit(key), kind, norm, attempt.cast("string")), 256), of)


def render(kind: Column, entity: Column, drawn: Column) -> Column:
    """A replacement in the entity's own spelling: its case, and its digits' layout."""

    def laid(state: Column, c: Column) -> Column:
        isdigit = c.rlike("[0-9]")
        return F.struct(F.concat(state["out"], F.when(isdigit, F.substring(drawn, state["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(isdigit, state["at"] + 1).otherwise(state["at"]).alias("at"))

    digits = F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), laid, lambda s: s["out"])
    cased = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(drawn)).otherwise(drawn)
    spaced = F.when(entity.contains(" "), F.rtrim(F.regexp_replace(drawn, "(.{4})", "$1 "))).otherwise(drawn)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", spaced).otherwise(cased)


def entities_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def seal_key(key: str) -> Column:
    return F.unhex(F.lit(hashlib.sha256(f"seal\0{key}".encode()).hexdigest()))


def sealed(norm: Column, key: str) -> Column:
    """norm encrypted under the key: equal forms give equal bytes."""
    return F.aes_encrypt(norm.cast("binary"), seal_key(key), F.lit("ECB"))


def unsealed(norm: Column, key: str) -> Column:
    return F.aes_decrypt(norm, seal_key(key), F.lit("ECB")).cast("string")


def redraws(entities: DataFrame, key: str = TEST_KEY) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first draw isn't kept. entities: distinct (kind, norm)."""
    hidden = entities.select("kind", sealed(F.col("norm"), key).alias("norm"))
    return sealed_redraws(hidden, key).withColumn("norm", unsealed(F.col("norm"), key))


def sealed_redraws(entities: DataFrame, key: str) -> DataFrame:
    """redraws() of sealed forms, as a stored table of sealed forms."""
    drawn = entities.select("kind", "norm", F.lit(0).alias("attempt"))
    fewest, idle, last = None, 0, []
    while True:
        opened = drawn.withColumn("opened", unsealed(F.col("norm"), key))
        chosen = draw(F.col("kind"), F.col("opened"), F.col("attempt"), key)
        drawn = stored(opened.select("kind", "norm", "attempt", sealed(chosen, key).alias("drawn")), "draws")
        discard(*last)
        kept = drawn.groupBy("kind", "drawn").agg(F.min(F.struct("attempt", "norm")).alias("kept"), F.count("*").alias("n"))
        clashing = drawn.join(kept.where("n > 1").select("kind", "drawn", F.col("kept.norm").alias("keeper")), ["kind", "drawn"]).where("norm <> keeper").select("kind", "norm")
        real = drawn.join(entities.select("kind", F.col("norm").alias("drawn")), ["kind", "drawn"], "left_semi").select("kind", "norm")
        again = stored(clashing.unionByName(real).distinct(), "clashes")
        n = again.count()
        if not n:
            found = stored(drawn.where("attempt > 0").select("kind", "norm", "attempt"), "redrawn")
            discard(drawn, again)
            return found
        fewest, idle = (n, 0) if fewest is None or n < fewest else (fewest, idle + 1)
        if idle == STUCK:
            discard(drawn, again)
            raise ValueError(f"{n} entities have no replacement that nothing else has: the space of their type is full")
        last = [drawn, again]
        drawn = drawn.join(again.withColumn("more", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def pseudonymise(docs: DataFrame, key: str = TEST_KEY, doc_id: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """docs with its texts rewritten, all other columns as they are; count: a column for the number of entities."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.flatten(F.transform(entities_of(F.col(text)), identities))).alias("e")).select("doc_id", "e.kind", sealed(F.col("e.norm"), key).alias("norm"))
    found = stored(found, "found")
    redrawn = sealed_redraws(found.select("kind", "norm").distinct(), key)
    by_doc = found.distinct().join(redrawn, ["kind", "norm"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", "kind", F.hex("norm")).alias("k"), F.col("attempt").alias("v")))).alias("__redrawn"))
    touched = stored(by_doc, "touched")
    discard(found, redrawn)
    few = touched.count() <= BROADCAST_ROWS
    touched = touched.withColumnRenamed("doc_id", "__doc_id")
    met = docs.join(F.broadcast(touched) if few else touched, docs[doc_id].eqNullSafe(touched["__doc_id"]), "left")

    def replaced(entity: Column) -> Column:
        def of(e: Column) -> Column:
            known = F.try_element_at(F.col("__redrawn"), F.concat_ws(" ", e["kind"], F.hex(sealed(e["norm"], key))))
            attempt = F.when(F.col("__redrawn").isNull(), 0).otherwise(F.coalesce(known, F.lit(0)))
            return draw(e["kind"], e["norm"], attempt, key)

        def shown(drawn: Column) -> Column:
            return let(type_of(entity), lambda kind: F.when(kind == "name", F.concat(title_of(entity), F.array_join(drawn, " "))).otherwise(render(kind, entity, F.element_at(drawn, 1))))

        return let(F.transform(identities(entity), of), shown)

    def rewritten(entities: Column) -> Column:
        pieces = F.split(F.col(text), ENTITY, -1)
        return F.when(F.size(entities) < 1, F.col(text)).otherwise(F.array_join(F.zip_with(pieces, F.transform(entities, replaced), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))

    both = let(entities_of(F.col(text)), lambda found: F.struct(F.coalesce(F.array_size(found), F.lit(0)).alias("n"), rewritten(found).alias("text")))
    made = met.withColumn("__made", both).withColumn(text, F.col("__made.text"))
    return (made if count is None else made.withColumn(count, F.col("__made.n"))).drop("__redrawn", "__doc_id", "__made")


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), session_key(spark), count="n_entities").select("doc_id", "text", "n_entities")
