"""PII: surrogate generation (DataFrame functions only).

Detected entities (e-mail, phone, IP address, card, social security number, IBAN,
hexadecimal secret, personal name) receive keyed replacements of the same type
and format.  The replacement is a function of the key, the type and the
canonical value, so all mentions of an entity in any document agree
(coreference) however they are written; names keep gender, script and capitals.

Distinctness is checked: the entities of the corpus form one table, and a
surrogate that two entities share, that was given before or that is a real value
of the corpus is drawn anew for all but its first owner, until none collides.

Texts without an entity pass through a narrow filter.  Texts with entities are
cut into the pieces between entities and meet their replacements by a hash of the
whole text, so exact copies share one lookup and a group of copies of any size is
aggregated before it is joined.

Defined cases: null texts stay null, empty texts empty; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import materialise, read_table

KEY = "change-me"

# fixed values: first names by gender and script, titles, syllables of surrogate surnames
FIRST_NAMES = {
    "male_latin": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew".split(),
    "female_latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily".split(),
    "male_cyrillic": "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Павел Владимир".split(),
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Екатерина Татьяна Ирина Светлана Юлия".split(),
}
TITLES = "Mr Mrs Ms Miss Mister Dr Prof Herr Frau Señor Señora Monsieur Madame Mme Господин Госпожа".split()
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ra se ti vo wa xi yo".split(),
    "cyrillic": "ба де фи го ку ла ме ни по ра се ти во ву зи ле".split(),
}

_GAP = r"[^\p{L}\d\n]{1,6}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Alternatives in order of preference; every one starts at a character that is not inside a longer word or number.
PATTERNS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]++@[\p{L}\d-]+(?:\.[\p{L}\d-]+)*\.\p{L}{2,}",
    "phone": rf"\+\d{{1,3}}{_GAP}\d{{2,4}}{_GAP}\d{{3,4}}[ .-]?\d{{3,4}}(?!\d)|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}(?!\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "secret": r"(?<![\p{L}\d])[0-9a-fA-F]{32,128}(?![\p{L}\d])",
    "card": r"(?<![\p{L}\d])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?![\p{L}\d])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
}


def _name_pattern() -> str:
    word = r"(?:\p{Lu}\p{Ll}+|\p{Lu}{2,})"
    titles = "|".join(TITLES + [t.upper() for t in TITLES if len(t) > 2])
    firsts = [n for names in FIRST_NAMES.values() for n in names]
    listed = "|".join(firsts + [n.upper() for n in firsts])
    return rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{titles})\.? {word}(?: {word})?|(?:{listed}) {word})(?!\p{{L}})"


_COUNTED = "|".join(PATTERNS.values())
_NAMES = _name_pattern()
ENTITY = f"{_COUNTED}|{_NAMES}"


def has_entity(text: Column) -> Column:
    """True for texts with an entity; texts without digits and @ are only searched for names."""
    found = (text.rlike("[0-9@]") & text.rlike(_COUNTED)) | text.rlike(_NAMES)
    return F.coalesce(found, F.lit(False))


def _kind(match: Column) -> Column:
    out = F.when(match.contains("@"), "email").when(match.rlike(r"^[+(]"), "phone").when(match.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
    out = out.when(match.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(match.rlike(r"^[0-9a-fA-F]{32,}$"), "secret").when(match.rlike(r"^\d"), "card")
    return out.when(match.rlike(r"^[A-Z]{2}\d"), "iban").otherwise("name")


def _word_kind(word: Column) -> Column:
    """Type of one word of a name; null for titles."""
    proper = F.initcap(word)
    bare = F.regexp_replace(proper, r"\.$", "")
    out = F.when(bare.isin(TITLES), F.lit(None).cast("string"))
    for group, names in FIRST_NAMES.items():
        out = out.when(proper.isin(names), F.lit(f"first_{group}"))
    return out.when(word.rlike(r"\p{IsCyrillic}"), "surname_cyrillic").otherwise("surname_latin")


def _canonical(kind: Column, value: Column) -> Column:
    """The part of a mention that names the entity."""
    digits = F.regexp_replace(value, r"\D", "")
    country = F.regexp_extract(value, r"^\+(\d+)", 1)
    phone = F.concat(country, F.lit("|"), F.substr(digits, F.length(country) + 1))
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(F.lower(value))


def _pick(stream: Column, i: Column, n: int) -> Column:
    """Number below ``n`` from the i-th pair of digits of a hexadecimal stream."""
    return F.conv(F.substr(stream, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") % n


def _shaped(value: Column, stream: Column) -> Column:
    """``value`` with digits and letters replaced by others of their class."""
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: (
        F.when(c.rlike(r"\d"), _pick(stream, i, 10).cast("string"))
        .when(c.rlike(r"\p{Lu}"), F.char(F.lit(65) + _pick(stream, i, 26)))
        .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + _pick(stream, i, 26))).otherwise(c)
    )), "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; digits at even (0) or odd (1) positions from the left are doubled."""
    def part(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, x: a + x)


def _surrogate(kind: Column, value: Column, attempt: int, key: str) -> Column:
    """Replacement of a canonical value, itself in canonical form."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))).cast("binary"), 512)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    email = F.concat(_shaped(local, stream), F.lit("@"), _shaped(F.substring_index(domain, ".", 1), F.reverse(stream)), F.lit("."), F.substr(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(70), F.lit(4 + attempt)), F.lit(".example"))
    cc, rest = F.substring_index(value, "|", 1), F.substring_index(value, "|", -1)
    octets = [F.lit(11) + _pick(stream, F.lit(0), 116), *[F.lit(1) + _pick(stream, F.lit(k), 254) for k in (1, 2, 3)]]
    private = F.when(value.startswith("10."), F.lit("10.")).when(value.startswith("192.168."), F.lit("192.168."))
    dotted = F.concat_ws(".", *[o.cast("string") for o in octets])
    ip = F.when(private == "10.", F.concat(private, F.substring_index(dotted, ".", -3))).when(private.isNotNull(), F.concat(private, F.substring_index(dotted, ".", -2))).otherwise(dotted)
    payload = F.concat(F.left(value, F.lit(1)), F.left(_shaped(F.substr(value, F.lit(2)), stream), F.lit(14)))
    check = (F.lit(10) - _luhn(payload, 0) % 10) % 10
    valid = _luhn(value, 0) % 10 == 0
    card = F.concat(payload, F.when(valid, check).otherwise((check + 1 + _pick(stream, F.lit(60), 9)) % 10).cast("string"))
    out = F.when(kind == "email", email).when(kind == "phone", F.concat(cc, F.lit("|"), _shaped(rest, stream))).when(kind == "ip", ip)
    out = out.when(kind == "card", card).when(kind == "ssn", _shaped(value, stream)).when(kind == "iban", F.concat(F.left(value, F.lit(2)), _shaped(F.substr(value, F.lit(3)), stream)))
    out = out.when(kind == "secret", F.left(stream, F.length(value)))
    for script, syllables in SYLLABLES.items():
        parts = F.array(*[F.lit(s) for s in syllables])
        made = F.concat(*[F.element_at(parts, _pick(stream, F.lit(k), 16) + 1) for k in range(4 + attempt)])
        if script == "cyrillic":  # surnames agree with the gender by their ending
            made = F.concat(made, F.when(value.rlike("[ая]$"), "ва").otherwise("в"))
        out = out.when(kind == f"surname_{script}", made)
    for group, names in FIRST_NAMES.items():  # a keyed rotation of the list: distinct, and never the name itself
        low = F.array(*[F.lit(n.lower()) for n in names])
        turn = F.conv(F.substr(F.sha2(F.lit(f"{key}\x1f{group}").cast("binary"), 256), F.lit(1), F.lit(6)), 16, 10).cast("int") % (len(names) - 1) + 1
        out = out.when(kind == f"first_{group}", F.element_at(low, (F.array_position(low, value).cast("int") - 1 + turn) % len(names) + 1))
    return out


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no two alike in a kind, none a real value."""
    todo = real = materialise(entities.select("kind", "value").distinct())
    done, attempt = None, 0
    while todo.limit(1).count():
        drawn = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("value"), attempt, key))
        drawn = materialise(drawn)
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        fixed = F.col("kind").startswith("first_")
        taken = real.filter(~fixed).select("kind", F.col("value").alias("surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        fine = materialise(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"))
        done = fine if done is None else materialise(done.unionByName(fine))
        todo = materialise(todo.join(fine, ["kind", "value"], "left_anti"))
        attempt += 1
    return done if done is not None else real.withColumn("surrogate", F.col("value"))


def _written(kind: Column, said: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention ``said``."""
    digits = F.regexp_replace(surrogate, r"\D", "")
    filled = F.array_join(F.transform(F.split(said, ""), lambda c, i: F.when(
        c.rlike(r"\d"), F.substr(digits, F.length(F.regexp_replace(F.substr(said, F.lit(1), i + 1), r"\D", "")), F.lit(1))
    ).otherwise(c)), "")
    grouped = F.array_join(F.transform(F.split(said, ""), lambda c, i: F.when(
        c != " ", F.substr(surrogate, F.length(F.regexp_replace(F.substr(said, F.lit(1), i + 1), " ", "")), F.lit(1))
    ).otherwise(c)), "")
    upper = (said == F.upper(said)) & (said != F.lower(said))
    cased = F.when(upper, F.upper(surrogate)).when(kind.startswith("surname") | kind.startswith("first"), F.initcap(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind == "iban", grouped).otherwise(cased)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, plus n_entities (mentions; that column is replaced)."""
    rest = [c for c in docs.columns if c not in ("text", "n_entities")]
    keep = [F.col(f"`{c}`") for c in rest]
    base = docs.select(*keep, F.col("text").cast("string").alias("text"))
    clean = base.filter(~has_entity(F.col("text"))).select(*keep, "text", F.lit(0).cast("long").alias("n_entities"))
    regex = F.lit(ENTITY)
    ident = ["__h1", "__h2"]
    held = materialise(base.filter(has_entity(F.col("text"))).select(
        *keep, F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), "text").alias("__h2"),
        F.regexp_extract_all("text", regex, F.lit(0)).alias("__said"), F.split("text", ENTITY, -1).alias("__between"),
    ))
    texts = held.groupBy(*ident).agg(F.first(F.array_distinct("__said")).alias("said"))
    mentions = texts.select(*ident, F.explode("said").alias("said")).withColumn("kind", _kind(F.col("said")))
    words = mentions.filter(F.col("kind") == "name").select(*ident, F.explode(F.split("said", " ")).alias("said"))
    words = words.withColumn("kind", _word_kind(F.col("said"))).filter(F.col("kind").isNotNull()).distinct()
    mentions = materialise(mentions.filter(F.col("kind") != "name").unionByName(words).withColumn("value", _canonical(F.col("kind"), F.col("said"))))
    given = mentions.join(surrogates(mentions, key), ["kind", "value"]).select(*ident, "said", _written(F.col("kind"), F.col("said"), F.col("surrogate")).alias("new"))
    lookup = given.groupBy(*ident).agg(F.map_from_entries(F.collect_list(F.struct("said", "new"))).alias("__lookup"))
    joined = held.join(lookup, ident, "left").withColumn("__lookup", F.coalesce("__lookup", F.create_map().cast("map<string,string>")))
    by = F.col("__lookup")
    new = F.transform("__said", lambda m: F.coalesce(F.try_element_at(by, m), F.array_join(F.transform(F.split(m, " "), lambda w: F.coalesce(F.try_element_at(by, w), w)), " ")))
    pairs = F.zip_with("__between", F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    changed = joined.select(*keep, F.array_join(pairs, "").alias("text"), F.size("__said").cast("long").alias("n_entities"))
    return clean.unionByName(changed)


def op6_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities of every document."""
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
