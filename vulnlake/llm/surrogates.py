"""Personal data replaced by keyed surrogates of the same type, gender, script and format, with DataFrame functions only.

A detected entity is reduced to a normal form (digits of a number, lower case of an address) and a digest of key, type
and normal form draws the surrogate character by character: digits stay digits, letters letters of the same case,
separators stay. Cards keep their network digit and pass the Luhn test if they did; addresses end in a reserved domain;
IPv4 addresses move to the reserved block 240/4; names keep their title and particles (van, de la) and get initials for initials and
else syllables of their script with an ending of the title's gender, part by part, so that a name and its surname alone
still agree.

Equal normal forms get equal surrogates in all documents. Two normal forms of a type never share one: over the distinct
entities, a surrogate that another entity has, or that is itself an entity of the corpus, is drawn again with a higher
attempt number until none is left. The space grows with the attempts, so that this ends for any number of entities: addresses
get a longer host label, names one more syllable, secrets more characters, and what has a fixed form gets digits behind it
after ``FIXED`` attempts in it. Only entities with an attempt number above 0 enter the join that replaces them.

Edge cases. A null text stays null in ``replace_in`` and counts as empty in ``surrogates``. Repeated rows are treated
alike. Documents without an entity pass unchanged. An empty table gives an empty result. ``replace_in`` keeps all columns,
whatever their names, and sets ``n_chars`` to the new length where there is such a column.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import let, table, written
from vulnlake.llm.registry import query

#: Setting that holds the key. Without it a session draws a key of its own, so no key is public.
KEY = "spark.vulnlake.surrogates.key"
#: Titles that show a name and its gender (fixed values).
MALE = ["Mr", "Herr", "Herrn", "Señor", "Monsieur", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mademoiselle", "госпожа", "κυρία"]
#: Syllables by script, and endings by gender: male, female, family name (own values).
SYLLABLES = {
    "latin": (["ba", "bel", "cor", "da", "del", "fen", "gar", "hal", "jor", "ka", "lin", "mar", "nol", "per", "ros", "tam"], ["o", "an", "us", "ik"], ["a", "ia", "ena", "ine"], ["sen", "ler", "mont", "wick"]),
    "cyrillic": (["ба", "бел", "вар", "гор", "да", "дел", "зар", "ка", "лин", "мар", "нол", "пер", "рос", "сам", "тим", "фед"], ["ан", "ил", "ор", "ей"], ["а", "ия", "ина", "ена"], ["енко", "ин", "ук", "ич"]),
    "greek": (["βα", "γαρ", "δα", "ζα", "θε", "κα", "λιν", "μαρ", "νικ", "ξεν", "παρ", "ρο", "σταμ", "τιμ", "φιλ", "χαρ"], ["ος", "ης", "ας", "ων"], ["α", "η", "ια", "ινη"], ["ακης", "ιδης", "ου", "ας"]),
}
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE, key=len, reverse=True)) + r")\.?"
#: What names a secret: the end of a longer name (access_token, clientSecret), and its own quote may follow ("password": "...").
SECRET_NAME = r"(?:(?<![\p{L}\p{N}])(?i:password|passwd|secret|token|api[_-]?key)|(?<=[a-z0-9])(?:Password|Passwd|Secret|Token|Api_?Key))[\"']?"
#: Parts of a name: words (d'Alembert, al-Hassan), initials (Q., J.R., a single letter before another word) and particles.
NAME_WORD = rf"(?!{TITLE} )(?:[dl]['’]|al-|el-)?\p{{Lu}}[\p{{L}}\p{{M}}'’-]+"
INITIAL = r"(?:(?:\p{Lu}\.-?)+|\p{Lu}(?= \p{Lu}\p{L}))(?![\p{L}\p{M}])"
PARTICLE = r"(?:de l[ao]s?|und zu|van|von|vom|zu|zum|zur|der|den|dem|de|del|des|du|di|da|das|do|dos|della|y|af|av|ten|ter|te|bin|ibn|ben)(?!\p{L})"
#: A date of day, month and year with no more digits behind it is no phone number.
DATE = r"\d{1,2}[./-]\d{1,2}[./-](?:\d{4}|\d{2})(?![./-]?\d)"
#: Phone numbers: +1 and blocks of 3, 3 and 4; international in any blocks or one run; with a trunk 0 in any blocks or one run
#: or with a long last block; blocks as before; Spanish ones in pairs.
PHONES = [r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?![\w-])", r"(?:\+|00)[1-9](?:[ ./()-]{0,3}\d){7,14}(?![\w-])", r"\(?0[1-9]\d{0,4}\)?(?:[ ./-]{0,3}\d){7,11}(?![\w-])",
          r"\(?0[1-9]\d{1,3}\)?[ ./-]{1,3}\d{5,9}(?![\w-])", r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])",
          r"[6-9]\d{2}(?:[ .-]\d{2}){3}(?![\w-])", r"[89]\d[ .-]\d{3}(?:[ .-]\d{2}){2}(?![\w-])"]
#: Country codes of one and two digits; all others have three.
CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Types by precedence: how one starts in running text. Each pattern is read by Java's engine.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "aws": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<=[=: \"'])(?<={SECRET_NAME} ?[=:] ?[\"']?)[A-Za-z0-9+/_.~-]{{8,}}",
    "ipv4": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": rf"(?<![\w.+-])(?!{DATE})(?:{'|'.join(PHONES)})",
    "name": rf"(?<!\p{{L}}){TITLE} (?:(?:{PARTICLE}|{INITIAL}) )*+{NAME_WORD}(?:(?: {PARTICLE})*+ (?:{NAME_WORD}|{INITIAL}))*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Characters up to which an entity may be spelled with different separators.
ALIKE = 64
#: Attempts within the form of a number or address whose length is fixed.
FIXED = 16
#: A text without any of these has no entity.
HINT = r"[0-9@]|(?i:passw|secret|token|api[_-]?key)|" + "|".join(MALE + FEMALE)


def entities_of(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(entity: Column) -> Column:
    """Type of a detected entity: the first whose pattern it has in full; what only its surroundings show is a secret."""
    out = F.lit("secret")
    for name in reversed([n for n in PATTERNS if n != "secret"]):
        out = F.when(entity.rlike(rf"\A(?:{PATTERNS[name]})\z"), F.lit(name)).otherwise(out)
    return out


def normal(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return (F.when(kind == "email", F.lower(entity)).when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.regexp_extract(entity, r"\A\+?", 0), digits)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
            .when(kind == "name", F.regexp_replace(entity, rf"\A{TITLE} ", "")).otherwise(entity))


def digest(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm), 512)


def byte(d: Column, i: Column) -> Column:
    return F.conv(F.substring(d, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(values, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def redrawn(text: Column, d: Column) -> Column:
    """Every digit and letter drawn anew in its own class; hexadecimal strings stay hexadecimal. The k-th letter or digit uses
    the k-th byte, whatever stands between them. Only a secret has more than ``ALIKE`` characters; it has one spelling, so its
    k-th character uses the k-th byte, which spares counting."""
    facts = F.struct(text.rlike(r"\A[0-9a-f]{8,}\z").alias("hexadecimal"), (F.length(text) > ALIKE).alias("long"))

    def one(c: Column, i: Column, of: Column) -> Column:
        b = byte(d, F.when(of["long"], i).otherwise(F.length(F.regexp_replace(F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", ""))))
        letter = F.when(of["hexadecimal"], pick("abcdef", b)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", b))
        return F.when(c.rlike(r"\A[0-9]\z"), pick("0123456789", b)).when(c.rlike(r"\A[a-z]\z"), letter).when(c.rlike(r"\A[A-Z]\z"), F.upper(pick("abcdefghijklmnopqrstuvwxyz", b))).otherwise(c)

    return let(facts, lambda of: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, of)), ""))


def luhn(digits: Column) -> Column:
    """Sum of the Luhn test of a string of digits, its last one included."""
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)


def card(entity: Column, d: Column) -> Column:
    drawn = F.concat(F.substring(entity, 1, 1), F.substring(redrawn(entity, d), F.lit(2), F.length(entity)))
    digits = lambda x: F.regexp_replace(x, r"\D", "")
    body = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)
    check = F.pmod(F.lit(10) - F.pmod(luhn(F.concat(body(digits(drawn)), F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when(F.pmod(luhn(digits(entity)), F.lit(10)) == 0, F.concat(body(drawn), check)).otherwise(drawn)


def phone(entity: Column, d: Column) -> Column:
    """The country code or trunk 0 stays; the first digit after it, and that of the exchange in numbers of ten, are not 0 or 1
    unless they were. Separators play no part, so that one number in several forms stays one."""
    code = F.regexp_extract(entity, rf"\A(?:(?:\+|00){CODE}|\(?0(?!0))", 0)
    rest = F.substring(entity, F.length(code) + 1, F.length(entity))
    digits = F.regexp_replace(rest, r"\D", "")
    fresh = F.transform(F.split(redrawn(digits, d), ""), lambda c, i: F.when(((i == 0) | ((i == 3) & (F.length(digits) == 10))) & c.rlike("[01]") & ~F.substring(digits, i + 1, F.lit(1)).rlike("[01]"), pick("23456789", byte(d, i + 31))).otherwise(c))
    placed = lambda new: F.array_join(F.transform(F.split(rest, ""), lambda c, i: F.when(c.rlike(r"\A[0-9]\z"), F.element_at(new, F.length(F.regexp_replace(F.substring(rest, F.lit(1), i + 1), r"\D", "")))).otherwise(c)), "")
    return F.concat(code, let(fresh, placed))


def ipv4(d: Column) -> Column:
    return F.concat_ws(".", (240 + byte(d, F.lit(0)) % 15).cast("string"), *[byte(d, F.lit(k)).cast("string") for k in (1, 2)], (1 + byte(d, F.lit(3)) % 254).cast("string"))


def email(entity: Column, d: Column, attempt: Column) -> Column:
    """From attempt 1 on, a label of 4 letters per attempt (at most 60) is added to the host."""
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    host = F.when(F.size(F.split(domain, r"\.")) > 2, F.concat(redrawn(F.substring_index(domain, ".", 1), F.reverse(d)), F.lit("."))).otherwise("")
    label = F.translate(F.substring(F.sha2(d, 256), F.lit(1), F.least(attempt * 4, F.lit(60))), "0123456789", "ghijklmnop")
    more = F.when(attempt > 0, F.concat(label, F.lit("."))).otherwise("")
    return F.concat(redrawn(local, d), F.lit("@"), host, more, F.lit("example."), pick(["com", "net", "org"], byte(d, F.lit(63))))


def name(entity: Column, key: str, attempt: Column) -> Column:
    """Each part by itself: all but the last of several are given names, the last (or only one) is the family name."""
    title = F.regexp_extract(entity, rf"\A{TITLE}", 0)
    female = F.rtrim(title, F.lit(".")).isin(FEMALE)
    parts = F.split(F.substring(entity, F.length(title) + 2, F.length(entity)), " ")

    def drawn(part: Column, script: str, family: Column) -> Column:
        d = F.sha2(F.concat_ws("|", F.lit(key), F.lit("part"), attempt.cast("string"), part), 512)
        syllables, male, fem, last = SYLLABLES[script]
        longer = F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(32))), lambda k: pick(syllables, byte(d, k + 4)))
        more = F.when(attempt > 0, F.array_join(longer, "")).otherwise("")  # names run out: longer ones
        ending = F.when(family, pick(last, byte(d, F.lit(3)))).when(female, pick(fem, byte(d, F.lit(3)))).otherwise(pick(male, byte(d, F.lit(3))))
        word = F.concat(pick(syllables, byte(d, F.lit(0))), pick(syllables, byte(d, F.lit(1))), pick(syllables, byte(d, F.lit(2))), more, ending)
        initials = F.array_join(F.transform(F.split(part, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(pick(syllables, byte(d, i)), 1, 1))).otherwise(c)), "")
        return (F.when(part.rlike(r"\A\p{Ll}+\z"), part).when(part.rlike(r"\A(?:(?:\p{Lu}\.-?)+|\p{Lu})\z"), initials)
                .when(F.upper(part) == part, F.upper(word)).otherwise(F.initcap(word)))

    def one(part: Column, i: Column) -> Column:
        family = i == F.size(parts) - 1
        return F.when(part.rlike(r"\p{IsCyrillic}"), drawn(part, "cyrillic", family)).when(part.rlike(r"\p{IsGreek}"), drawn(part, "greek", family)).otherwise(drawn(part, "latin", family))

    return F.concat(title, F.lit(" "), F.array_join(F.transform(parts, one), " "))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        beyond = attempt - F.when(kind == "secret", 1).otherwise(FIXED)
        digits = F.translate(F.substring(F.sha2(d, 256), F.lit(1), F.least(beyond * 4, F.lit(64))), "abcdef", "012345")
        return F.concat(formed(d), F.when(~kind.isin("email", "name") & (beyond > 0), F.concat(F.when(kind == "secret", "").otherwise("-"), digits)).otherwise(""))

    def formed(d: Column) -> Column:
        return (F.when(kind == "email", email(entity, d, attempt)).when(kind == "aws", F.concat(F.lit("AKIA"), redrawn(F.substring(entity, 5, 16), d))).when(kind == "ipv4", ipv4(d))
                .when(kind == "card", card(entity, d)).when(kind == "phone", phone(entity, d)).when(kind == "name", name(entity, key, attempt))
                .when(kind == "iban", F.concat(F.substring(entity, 1, 2), redrawn(F.substring(entity, F.lit(3), F.length(entity)), d))).otherwise(redrawn(entity, d)))

    return let(digest(key, kind, normal(kind, entity), attempt), of)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm and attempt (above 0) of the entities that must be drawn again."""
    e = written(entities.groupBy("kind", "norm").agg(F.min("entity").alias("entity")).withColumn("attempt", F.lit(0)), "entities")
    while True:
        drawn = e.withColumn("drawn", normal(F.col("kind"), surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key)))
        drawn = written(drawn, "drawn")
        taken = drawn.groupBy("kind", "drawn").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "drawn", "owner")
        real = e.select("kind", F.col("norm").alias("drawn"), F.lit(True).alias("real"))
        judged = drawn.join(taken, ["kind", "drawn"], "left").join(real, ["kind", "drawn"], "left")
        again = F.coalesce(F.col("owner") != F.col("norm"), F.lit(False)) | F.coalesce("real", F.lit(False))
        judged = written(judged.select("kind", "norm", "entity", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "entities")
        e = judged.drop("again")
        if judged.where("again").isEmpty():
            return e.where("attempt > 0").select("kind", "norm", "attempt")


def key_of(spark: SparkSession) -> str:
    key = spark.conf.get(KEY, None)
    if not key:
        spark.conf.set(KEY, key := secrets.token_hex(32))
    return key


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``_row`` (all columns of ``docs``), ``_text`` with surrogates and ``_n``, the entities in it."""
    key = key or key_of(docs.sparkSession)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text")).withColumn("_found", F.coalesce(entities_of(F.col("_text")), F.array().cast("array<string>")))
    # Only documents with an entity take part in what follows; a number written with them tells them apart.
    some = written(marked.where(F.size("_found") > 0).withColumn("_id", F.monotonically_increasing_id()), "with-entities")
    each = some.select("_id", F.posexplode("_found").alias("pos", "entity")).withColumn("kind", kind_of(F.col("entity")))
    each = written(each.withColumn("norm", normal(F.col("kind"), F.col("entity"))), "occurrences")
    again = attempts(each, key)
    new = each.join(again, ["kind", "norm"], "left").select("_id", "pos", surrogate(F.col("kind"), F.col("entity"), F.coalesce("attempt", F.lit(0)), key).alias("new"))
    of_doc = new.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("_new"))  # as many as the document has
    gaps = F.split("_text", ANY, -1)
    built = let(gaps, lambda g: F.concat(F.array_join(F.zip_with(F.slice(g, F.lit(1), F.size("_new")), "_new", lambda a, b: F.concat(a, b["new"])), ""), F.element_at(g, -1)))
    done = some.join(of_doc, "_id").select("_row", built.alias("_text"), F.size("_new").cast("long").alias("_n"))
    return done.unionByName(marked.where(F.size("_found") == 0).select("_row", "_text", F.lit(0).cast("long").alias("_n")))


def replace_in(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``."""
    new = {"text": F.col("_text"), "n_chars": F.length(F.coalesce("_text", F.lit(""))).cast("long")}
    return replaced(docs, key).select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


@query("op4_pii_surrogates")
def op4_pii_surrogates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replaced(docs).select(F.col("_row.doc_id").alias("doc_id"), F.coalesce("_text", F.lit("")).alias("text"), F.col("_n").alias("n_entities"))
