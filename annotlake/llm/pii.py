"""Personal data: detected entities receive keyed, type-consistent surrogates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotlake.llm.common import packed, release, sized_broadcast, text_key
from annotlake.plans.durable import cut

# First names by gender and script; a surrogate's first name comes from them while they last.
FEMALE = "Anna Maria Elena Laura Julia Sofia Clara Emma Nora Alice Irene Marta Paula Helen Diana Vera Lucia Rosa Ida Eva".split()
MALE = "Paul Peter Thomas Martin Lucas David Daniel Simon Victor Oscar Hugo Anton Felix Max Leo Karl Robert Philip Mark Jonas".split()
FEMALE_CYRILLIC = "Анна Мария Елена Ольга Ирина Наталья Светлана Татьяна Вера Юлия".split()
MALE_CYRILLIC = "Иван Пётр Сергей Андрей Алексей Дмитрий Николай Павел Виктор Юрий".split()
TITLES = {"female": "Mrs Ms Miss Frau Madame Mme Señora Sra Г-жа", "male": "Mr Herr Monsieur Señor Sr Г-н", "": "Dr Prof"}
# Onsets and vowels of syllables by script, and endings of surnames and of first names by gender.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v z", "a e i o u"),
    "cyrillic": ("б в г д ж з к л м н п р с т", "а е и о у"),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο"),
}
SURNAME_ENDS = {
    "latin": {"f": "ner lin mann sen ton dal", "m": "ner lin mann sen ton dal", "u": "ner lin mann sen ton dal"},
    "cyrillic": {"f": "лова нева рина мова", "m": "лов нев рин мов", "u": "ленко сюк вич ренко"},
    "greek": {"f": "λου κη", "m": "λος κης", "u": "λης ρας"},
}
FIRST_ENDS = {
    "latin": {"f": "na lia ra", "m": "n r s", "u": "l m"},
    "cyrillic": {"f": "на рия ла", "m": "н р с", "u": "ль м"},
    "greek": {"f": "να ρα", "m": "νος ρος", "u": "λης μις"},
}
SYLLABLES = {script: [o + v for o in onsets.split() for v in vowels.split()] for script, (onsets, vowels) in SOUNDS.items()}

_NOT_WORD = r"(?<![\p{L}\p{N}_])"
_END = r"(?![\p{L}\p{N}_])"
_TITLE = "|".join(x for v in TITLES.values() for x in v.split())
_NAME = r"(?:\p{Lu}['’])?\p{Lu}[\p{Ll}\p{M}]+(?:-\p{L}[\p{Ll}\p{M}]+|['’]\p{Lu}[\p{Ll}\p{M}]+)*"

# One pattern a kind; earlier kinds win where two could begin at the same place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}" + _END,
    "secret": _NOT_WORD + r"(?i:token|secret|password|passwd|api_?key|access_?key)\s*[:=]\s*[\"'][^\"'\s]{8,}[\"']",
    "key": _NOT_WORD + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk[-_](?:live_|test_)?[A-Za-z0-9]{20,})" + _END,
    "iban": _NOT_WORD + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": r"(?<![\p{L}\p{N}_.+-])(?:\d{4}[ -]?){3}\d{4}(?![\p{L}\p{N}_-]|\.\d)",
    "ssn": r"(?<![\p{L}\p{N}_.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])",
    "ip": r"(?<![\p{L}\p{N}_.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}_]|\.\d)",
    "ip6": r"(?<![\p{L}\p{N}_:.])(?=[A-Fa-f]{0,3}\d)[0-9A-Fa-f]{4}(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}_:])",
    "phone": r"(?<![\p{L}\p{N}_.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\b\d{3}[.-])\d{3}[ .-]\d{4}" + _END + r"|(?<![\p{L}\p{N}_.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}" + _END,
    "name": _NOT_WORD + rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME})?" + _END,
}
ANY = "|".join(PATTERNS.values())
# A text without any of these holds no entity.
HINT = rf"@|\d[\d .()-]{{5,}}\d|[:=]\s*[\"']|AKIA|gh[pousr]_|sk[-_]|[A-Z]{{2}}\d{{2}}|[0-9A-Fa-f]{{4}}:[0-9A-Fa-f:]*:|(?:{_TITLE})\.? \p{{Lu}}"
# Two capitalised words, the first of them no title; pairs may overlap.
PAIR = rf"{_NOT_WORD}(?!(?:{_TITLE})\.? )(?=({_NAME} {_NAME}){_END})"


def luhn(number: Column) -> Column:
    """Whether the digits of a number add up by the Luhn rule."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, r"\D", "")), ""), lambda d: d.try_cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def kind_of(entity: Column) -> Column:
    """The kind of a match of ``ANY``; null for sixteen digits that are no card number."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        hit = entity.rlike(f"^(?:{pattern})$")
        out = F.when(hit & luhn(entity) if kind == "card" else hit, F.lit(kind)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """One spelling for all spellings of an entity: e-mail and IBAN without case, numbers as digits, names without title."""
    digits = F.regexp_replace(entity, r"\D", "")
    secret = F.regexp_extract(entity, r"[\"']([^\"'\s]+)[\"']", 1)
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits))
        .when(kind.isin("email", "iban", "ip6"), F.regexp_replace(F.lower(entity), " ", ""))
        .when(kind == "secret", secret)
        .when(kind == "name", F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", ""))
        .otherwise(entity)
    )


def _gender(entity: Column) -> Column:
    title = F.regexp_extract(entity, rf"^({_TITLE})\.? ", 1)
    first = F.regexp_extract(entity, r"\.? (\p{Lu}\S+)", 1)
    female = title.isin(TITLES["female"].split()) | first.isin(FEMALE + FEMALE_CYRILLIC)
    male = title.isin(TITLES["male"].split()) | first.isin(MALE + MALE_CYRILLIC)
    return F.when(female, F.lit("f")).when(male, F.lit("m")).otherwise(F.lit("u"))


def _stream(seed: Column) -> Column:
    """160 digits that depend on the whole seed."""
    parts = [F.sha2(F.concat(seed, F.lit(f"/{i}")), 256) for i in range(3)]
    return F.translate(F.concat(*parts), "abcdef", "135792")


def _pick(words: list[str], seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64(seed), F.lit(len(words))).cast("int") + 1)


def _letters(seed: Column, length: Column) -> Column:
    return F.substr(F.translate(F.sha2(seed, 512), "0123456789", "ghijkmnpqr"), F.lit(1), length)


def _script(form: Column) -> Column:
    return F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(form: Column, made) -> Column:
    """``made(script)`` of the script that a form is written in."""
    script = _script(form)
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def _spoken(seed: Column, script: str, count: Column, gender: Column, ends: dict[str, dict[str, str]]) -> Column:
    """A capitalised word of ``count`` keyed syllables with an ending of its gender."""
    stem = F.transform(F.sequence(F.lit(1), count), lambda i: _pick(SYLLABLES[script], F.concat(seed, F.lit("+"), i.cast("string"))))
    end = lambda g: _pick(ends[script][g].split(), F.concat(seed, F.lit("-")))
    return F.initcap(F.concat(F.array_join(stem, ""), F.when(gender == "f", end("f")).when(gender == "m", end("m")).otherwise(end("u"))))


def _surname_like(seed: Column, form: Column, attempt: Column) -> Column:
    """A surname in the script, gender ending and layout (prefix as in O'Brien, hyphen) of ``form``; more syllables with every second draw."""
    gender = F.when(form.rlike("(?:ова|ева|ёва|ина|ая)$"), "f").when(form.rlike("(?:ов|ев|ёв|ин|ий)$"), "m").otherwise("u")
    count = F.greatest(F.lit(2), F.least(F.lit(4), F.floor(F.length(form) / 2).cast("int") - 1)) + F.floor(attempt / 2).cast("int")
    part = lambda salt: _by_script(form, lambda script: _spoken(F.concat(seed, F.lit(salt)), script, count, gender, SURNAME_ENDS))
    prefix = F.regexp_extract(form, r"^(\p{Lu}['’])", 1)
    return F.concat(prefix, part("a"), F.when(form.contains("-"), F.concat(F.lit("-"), part("b"))).otherwise(F.lit("")))


def _first_like(seed: Column, form: Column, gender: Column, attempt: Column) -> Column:
    """A first name of the script and gender of ``form``, another one than its own: from the lists for three draws, then by syllables."""
    own = F.substring_index(form, " ", 1)

    def other(words: list[str]) -> Column:
        drawn = _pick(words[:-1], seed)
        return F.when(drawn == own, F.lit(words[-1])).otherwise(drawn)

    def listed(female: list[str], male: list[str]) -> Column:
        return F.when(gender == "f", other(female)).when(gender == "m", other(male)).otherwise(other(female + male))

    made = _by_script(form, lambda script: _spoken(seed, script, F.floor(attempt / 2).cast("int") + 1, gender, FIRST_ENDS))
    script = _script(form)
    known = F.when(script == "cyrillic", listed(FEMALE_CYRILLIC, MALE_CYRILLIC)).when(script == "latin", listed(FEMALE, MALE))
    return F.when(attempt < 3, F.coalesce(known, made)).otherwise(made)


def _shaped(text: Column, letters: Column, digits: Column) -> Column:
    """``text`` with keyed letters for its letters and keyed digits for its digits; all else stays in place."""
    at = lambda stream, i: F.substr(stream, F.pmod(i, F.length(stream)) + 1, F.lit(1))
    put = lambda c, i: F.when(c.rlike(r"^\p{L}$"), at(letters, i)).when(c.rlike(r"^\p{N}$"), at(digits, i)).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), put), "")


def _email_like(seed: Column, key: str, form: Column, attempt: Column) -> Column:
    """A local part of the same shape and script (longer from the fourth draw on) at a reserved domain; one domain has one surrogate."""
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    letters = _letters(seed, F.lit(128))
    script = F.when(local.rlike(r"\p{IsCyrillic}"), F.translate(letters, "abcdefghijkmnpqr", "абвгдежзиклмнопр")).otherwise(letters)
    longer = F.substr(F.reverse(script), F.lit(1), F.greatest(attempt - 2, F.lit(0)) * 3)
    host = F.lower(_spoken(F.concat(F.lit(f"{key}/@/"), domain), "latin", F.lit(2), F.lit("u"), SURNAME_ENDS))
    top = F.when(domain.rlike(r"\.(?:com|net)$"), F.substring(domain, -3, 3)).otherwise(F.lit("org"))
    return F.concat(_shaped(local, script, _stream(seed)), longer, F.lit("@"), host, F.lit(".example."), top)


def _ip6_like(seed: Column, form: Column, attempt: Column) -> Column:
    """An address of the private range fd00::/8 with the same groups; later draws put further groups after the first."""
    hexa = F.sha2(seed, 512)
    shaped = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substr(hexa, i + 1, F.lit(1)))), "")
    head = F.concat(F.lit("fd"), F.substring(_stream(seed), 1, 1))
    compact = F.concat(head, F.substring(hexa, 4, 1), F.lit(":"), F.substring(hexa, 50, 4), F.lit(":"), F.substring(hexa, 60, 4), F.lit("::"), F.substring(hexa, 70, 4))
    own = F.concat(head, F.substr(shaped, F.lit(4), F.length(shaped)))
    return F.when((attempt < 3) | ~form.contains("::"), own).otherwise(compact)


def core_of(kind: Column, form: Column, gender: Column, key: str, attempt: Column, family: Column | None = None) -> Column:
    """The surrogate of a canonical entity, before it is laid out like a mention of it.

    Cards keep sixteen digits, their first digit and the Luhn rule; phones keep length and,
    for ten digits, exchange 555; addresses lie in 10.0.0.0/8 or fd00::/8; e-mails keep the
    shape and script of the local part and move to a reserved domain; secrets keep length, prefix and
    alphabet; names keep gender, script, layout and the number of words, have no first name of the original's, and end in ``family`` where it is given.
    """
    seed = F.concat_ws("/", F.lit(key), kind, form, attempt.cast("string"))
    digits = _stream(seed)
    n = F.length(form)
    body = F.concat(F.substring(form, 1, 1), F.substring(digits, 1, 14))
    places = F.transform(F.split(F.reverse(body), ""), lambda d: d.try_cast("int"))
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))
    )
    card = F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))
    roomy = attempt < 3  # later draws come from the whole space of the format
    phone = F.when((n == 10) & roomy, F.concat(F.lit("2"), F.substring(digits, 1, 2), F.lit("555"), F.substring(digits, 3, 4))).otherwise(
        F.concat(F.substring(form, 1, 2), F.substr(digits, F.lit(1), F.greatest(n - 2, F.lit(0))))
    )
    h = F.xxhash64(seed)
    net = F.when(roomy, F.lit("10")).otherwise((F.pmod(F.shiftrightunsigned(h, 24), F.lit(223)) + 1).cast("string"))
    ip = F.concat_ws(".", net, *[F.pmod(F.shiftrightunsigned(h, s), F.lit(256)).cast("string") for s in (0, 8, 16)])
    prefix = F.regexp_extract(form, r"^(AKIA|gh[pousr]_|sk[-_](?:live_|test_)?)", 1)
    rest = F.greatest(n - F.length(prefix), F.lit(0))
    hexa = F.repeat(F.sha2(seed, 512), (rest / 128).cast("int") + 1)
    plain = F.substr(F.when(form.rlike("^[0-9a-f]+$"), hexa).when(kind == "key", F.upper(hexa)).otherwise(F.translate(hexa, "0123456789", "ghjkmnpqrs")), F.lit(1), rest)
    key_text = F.concat(prefix, plain)
    iban = F.concat(F.substring(form, 1, 2), F.substr(digits, F.lit(1), F.greatest(n - 2, F.lit(0))))
    name = F.concat(_first_like(seed, form, gender, attempt), F.lit(" "), family) if family is not None else _surname_like(seed, form, attempt)
    return (
        F.when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", F.when(roomy, F.concat(F.lit("9"), F.substring(digits, 1, 8))).otherwise(F.substring(digits, 1, 9)))
        .when(kind == "ip", ip)
        .when(kind == "ip6", _ip6_like(seed, form, attempt))
        .when(kind == "email", _email_like(seed, key, form, attempt))
        .when(kind == "iban", iban)
        .when(kind == "name", name)
        .otherwise(key_text)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, form, core`` for distinct ``kind, form, gender``: every entity its own surrogate, and none that the corpus holds.

    Surrogates come from a keyed hash of the entity and an attempt number. Entities whose
    surrogate another entity drew (the smallest form keeps it) or that is itself an entity
    of the corpus draw again, until none is left; each round only looks at those still open.
    A surname has one surrogate wherever it occurs, and full names end in the one of theirs.
    """
    full = (F.col("kind") == "name") & F.col("form").contains(" ")
    named = entities.where(full).withColumn("surname", _surname(F.col("form")))
    single = entities.where(~full).unionByName(named.select("kind", F.col("surname").alias("form"), F.lit("u").alias("gender")))
    single = cut(single.groupBy("kind", "form").agg(F.min("gender").alias("gender")))
    known = cut(entities.select("kind", "form").unionByName(single.select("kind", "form")).distinct().select("kind", F.col("form").alias("core")))
    cores = _drawn(single, known, key)
    families = cores.where("kind = 'name'").select(F.col("form").alias("surname"), F.col("core").alias("family"))
    whole = _drawn(cut(named.join(families, "surname").drop("surname")), known, key)
    return cut(cores.join(entities.select("kind", "form"), ["kind", "form"], "left_semi").unionByName(whole))


def _surname(form: Column) -> Column:
    return F.regexp_extract(form, r"(\S+)$", 1)


def _first(form: Column) -> Column:
    return F.substring_index(form, " ", 1)


def _drawn(entities: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``kind, form, core`` by rounds of draws; ``known`` are the cores not to be used."""
    family = F.col("family") if "family" in entities.columns else None
    open_ = entities.withColumn("attempt", F.lit(0))
    settled = None
    while True:
        drawn = open_.withColumn("core", core_of(F.col("kind"), F.col("form"), F.col("gender"), key, F.col("attempt"), family))
        drawn = drawn.join(known.withColumn("taken", F.lit(True)), ["kind", "core"], "left")
        if settled is not None:
            drawn = drawn.join(settled.select("kind", "core", F.lit(True).alias("used")), ["kind", "core"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        drawn = cut(drawn)
        first = drawn.groupBy("kind", "core").agg(F.min("form").alias("winner"))
        judged = cut(
            drawn.join(first, ["kind", "core"]).withColumn("good", (F.col("form") == F.col("winner")) & F.col("taken").isNull() & F.col("used").isNull())
        )
        won = judged.where("good").select("kind", "form", "core")
        settled = won if settled is None else settled.unionByName(won)
        open_ = judged.where("not good").select(*entities.columns, (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return cut(settled)


def laid_out(kind: Column, entity: Column, core: Column) -> Column:
    """A surrogate in the layout of one mention: its punctuation, spacing, country code, title, quotes and case."""
    given = F.split(F.regexp_replace(core, r"\D", ""), "")
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    extra = F.greatest(digits - F.length(core), F.lit(0))
    chars = F.split(entity, "")
    at = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("k")),
        lambda a, c: F.when(
            c.rlike(r"^[0-9]$"),
            F.struct(
                F.concat(a["out"], F.when(a["k"] < extra, c).otherwise(F.coalesce(F.try_element_at(given, a["k"] - extra + 1), c))).alias("out"),
                (a["k"] + 1).alias("k"),
            ),
        ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k"))),
    )["out"]
    lead = F.regexp_extract(entity, r"^([^\"']*[\"'])", 1)
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    email = F.when(entity == F.upper(entity), F.upper(core)).otherwise(core)
    spaced = F.when(entity.contains(" "), F.trim(F.regexp_replace(F.upper(core), "(.{4})", "$1 "))).otherwise(F.upper(core))
    return (
        F.when(kind.isin("card", "phone", "ssn"), at)
        .when(kind == "email", email)
        .when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(lead, core, F.substring(entity, -1, 1)))
        .when(kind == "name", F.concat(title, core))
        .otherwise(core)
    )


def mentions(docs: DataFrame, row: str) -> DataFrame:
    """``row, place, entity, kind, form, gender`` of every entity, by its place among the row's matches."""
    found = docs.where(F.col("text").rlike(HINT)).select(row, F.posexplode(F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))).alias("place", "entity"))
    found = found.withColumn("kind", kind_of(F.col("entity"))).where("kind is not null")
    return found.withColumn("form", canonical(F.col("kind"), F.col("entity"))).withColumn(
        "gender", F.when(F.col("kind") == "name", _gender(F.col("entity"))).otherwise(F.lit("u"))
    )


def _untitled(docs: DataFrame, found: DataFrame, evidence: int) -> DataFrame:
    """``t1, t2, form, gender`` of capitalised pairs whose first word is a titled person's first name, and whose second a surname, in ``evidence`` texts each."""
    names = found.where("kind = 'name'").select("t1", "t2", _first(F.col("form")).alias("first"), _surname(F.col("form")).alias("last"), F.col("form").contains(" ").alias("full"), "gender")

    def seen(word: str, rows: DataFrame) -> DataFrame:
        texts = rows.groupBy(word, "t1", "t2").agg(F.min("gender").alias("gender"))
        return texts.groupBy(word).agg(F.min("gender").alias("gender"), F.count(F.lit(1)).alias("m")).where(F.col("m") >= evidence).drop("m")

    first, last = cut(seen("first", names.where("full"))), cut(seen("last", names).drop("gender"))
    pairs = docs.select(*text_key(), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PAIR), F.lit(1)))).alias("form"))
    pairs = pairs.withColumns({"first": _first(F.col("form")), "last": _surname(F.col("form"))})
    met = pairs.join(sized_broadcast(first, 100_000), "first").join(sized_broadcast(last, 100_000), "last")
    return met.select("t1", "t2", "form", "gender").distinct()


def _replacements(docs: DataFrame, key: str, evidence: int) -> DataFrame:
    """For each text that holds entities: its hash pair, its replacements by place, and its mentions in other forms."""
    texts = docs.where(F.col("text").rlike(HINT)).select("text", *text_key()).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    found = cut(mentions(texts.withColumn("row", F.struct("t1", "t2")), "row").select("row.t1", "row.t2", "place", "entity", "kind", "form", "gender"))
    untitled = cut(_untitled(docs, found, evidence).withColumn("kind", F.lit("name")))
    named = found.select("kind", "form", "gender").unionByName(untitled.select("kind", "form", "gender"))
    cores = surrogates(cut(named.groupBy("kind", "form").agg(F.min("gender").alias("gender"))), key)
    spelled = found.select("kind", "form", "entity").distinct().join(cores, ["kind", "form"])
    spelled = cut(spelled.select("kind", "form", "entity", laid_out(F.col("kind"), F.col("entity"), F.col("core")).alias("surrogate")))
    placed = found.join(spelled, ["kind", "form", "entity"]).select("t1", "t2", "place", "kind", "surrogate")
    put = placed.groupBy("t1", "t2").agg(F.map_from_entries(F.collect_list(F.struct("place", "surrogate"))).alias("put"), F.count(F.lit(1)).cast("int").alias("n"))
    held = found.select("t1", "t2", "kind", "form").unionByName(untitled.select("t1", "t2", "kind", "form"))
    return cut(put.join(_repeats(held.distinct().join(cores, ["kind", "form"])), ["t1", "t2"], "full"))


def _repeats(found: DataFrame) -> DataFrame:
    """For each text with names, phones or social security numbers: ``pattern`` of mentions in other forms, and ``again``: their kind and core by form.

    A surname, then a first name, alone stands for the full name that holds it; where two hold it, for the one with the smaller surrogate.
    """
    found = found.where(F.col("kind").isin("name", "phone", "ssn")).select("t1", "t2", "kind", "form", "core", F.lit(0).alias("rank"))
    names = found.where("kind = 'name'")
    full = names.where(F.col("form").contains(" "))
    entry = found.unionByName(names.withColumns({"form": _surname(F.col("form")), "core": _surname(F.col("core"))})).unionByName(
        full.withColumns({"form": _first(F.col("form")), "core": _first(F.col("core")), "rank": F.lit(1)})
    )
    entry = entry.groupBy("t1", "t2", "form").agg(F.min(F.struct("rank", "kind", "core")).alias("core"))
    entry = entry.withColumn("core", F.struct("core.kind", "core.core"))
    number = F.concat(F.when(F.length("form") == 10, F.lit(r"(?:\+?1[ .-]{0,2})?")).otherwise(F.lit(r"\+?")), F.lit(r"\(?"), F.regexp_replace("form", r"(\d)(?=\d)", "$1[ ./()-]{0,2}"))
    pattern = F.when(F.col("core.kind") == "name", F.col("form")).otherwise(number)
    listed = entry.groupBy("t1", "t2").agg(
        F.map_from_entries(F.collect_list(F.struct("form", "core"))).alias("again"),
        F.array_sort(F.collect_list(F.struct((-F.length("form")).alias("order"), pattern.alias("pattern")))).alias("patterns"),
    )
    either = F.array_join(F.transform("patterns", lambda p: p["pattern"]), "|")
    return listed.select("t1", "t2", "again", F.concat(F.lit(f"({_NOT_WORD}(?:"), either, F.lit(f"){_END})")).alias("pattern"))


def _again(part: Column, pattern: Column, again: Column) -> Column:
    """Text between mentions with surrogates for untitled or differently spaced repeats of the text's entities."""

    def surrogate(mention: Column) -> Column:
        digits = F.regexp_replace(mention, r"\D", "")
        short = F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits)
        met = F.try_element_at(again, F.when(digits == "", mention).otherwise(short))
        return F.when(met["kind"] == "name", met["core"]).otherwise(F.coalesce(laid_out(met["kind"], mention, met["core"]), mention))

    own = F.regexp_extract_all(part, pattern, F.lit(1))
    filled = F.transform(F.split(part, pattern, F.lit(-1)), lambda x, i: F.concat(x, F.coalesce(surrogate(F.try_element_at(own, i + 1)), F.lit(""))))
    return F.when(pattern.isNull(), part).otherwise(F.array_join(filled, ""))


def replace_entities(docs: DataFrame, key: str = "surrogates", count: str | None = None, evidence: int = 3) -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced by its surrogate; with ``count``, also the number replaced.

    One entity has one surrogate in all documents and spellings, two entities never share
    one, and no surrogate is an entity of the corpus. A surname has one too, in full names and alone.
    Names are found behind a title, and as two capitalised words whose first is a titled person's first
    name and whose second a titled person's surname, in at least ``evidence`` texts each. In a text that
    holds a name, its surname and its first name are also replaced alone, and phone and social security
    numbers in any spacing. A null or empty text, and a text without entities, stays as it is; an empty
    table gives an empty result; texts of any length are read whole; equal texts get equal results;
    other columns and repeated rows are untouched. The same key gives the same surrogates on the same corpus.
    """
    put = _replacements(docs, key, evidence)
    release(docs.sparkSession)
    line = put.select(F.struct("t1", "t2", "put", "n", "pattern", "again").alias("_put"))
    rows = packed(docs, F.col("text"), *text_key())
    met = rows.join(sized_broadcast(line, 100_000), (F.col("t1") == F.col("_put.t1")) & (F.col("t2") == F.col("_put.t2")), "left")
    between = F.split("text", F.lit(ANY), F.lit(-1))
    own = F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))
    pattern = F.col("_put.pattern")
    filled = F.transform(between, lambda x, i: F.concat(_again(x, pattern, F.col("_put.again")), F.coalesce(F.try_element_at(F.col("_put.put"), i), F.try_element_at(own, i + 1), F.lit(""))))
    text = F.when(F.col("_put").isNull(), F.col("text")).otherwise(F.array_join(filled, ""))
    repeats = F.aggregate(between, F.lit(0), lambda a, x: a + F.coalesce(F.regexp_count(x, pattern), F.lit(0)))
    replaced = F.when(F.col("_put").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("_put.n"), F.lit(0)) + F.coalesce(repeats, F.lit(0)))
    extra = [replaced.alias(count)] if count else []
    return met.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *extra)

