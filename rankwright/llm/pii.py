"""Personal data replaced by surrogates; DataFrame operations only.

Entities found in the texts are brought to a canonical form, so that two spellings of one entity
are one row of a table. Each gets a surrogate that follows from a key, the entity and the number of
the attempt: of the same type and length, names of the same gender and script, telephone numbers
of the same country code, card numbers of the same issuer digit and with a valid check digit if
they had one, IBANs of the same country with valid check digits. Surrogates that two entities share, or that are themselves an entity of the texts,
are drawn again until there are none, so different entities stay different and one entity is the
same everywhere. They are put into the texts in the format of each mention.

A title announces a person. Given and family name are entities of their own, so a name part has one
surrogate under every title, and without one: in a text that names a person by title, all further
capitalised mentions of the parts are replaced too. A title without gender (Dr) takes the gender of
a mention of the same full name in that text. A part alone is read as a family name if a person of
the text has it as one, else as a given name if one has it so, else as a family name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.session import write_table

#: Forms of address that announce a name, by gender. Fixed values.
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "г-жа", "κυρία"),
    "n": ("Mx", "Dr", "Prof"),
}
#: First names of the surrogates, by script and gender. Fixed values.
FIRST_NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Simon",
    ("latin", "f"): "Anna Bella Clara Diana Elena Flora Greta Helena Irene Julia Laura Maria Nora Olga Paula Sara",
    ("latin", "n"): "Alex Andrea Charlie Dominique Jamie Kim Lou Morgan Nicola Robin Sam Sasha Sky Toni Val Yuri",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Макар Никита Олег Павел Роман Тимур Юрий",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Полина Раиса Софья Юлия",
    ("cyrillic", "n"): "Женя Саша Валя Слава Паша Шура Тоня Вика Лера Мика Ника Рита Сима Тося Феня Яна",
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Θάνος Κώστας Λάμπρος Μάριος Νίκος Πάνος Πέτρος Σάββας Σπύρος Στέλιος Τάσος Χρήστος",
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Ξένια Όλγα Ρένα Σοφία",
    ("greek", "n"): "Άρη Βίκυ Γκάμπι Ντίνο Έλλη Ζήση Ήβη Θέμη Κίκι Λίλο Μίκι Νάνσυ Πόπη Ρούλη Σίλια Τόνια",
}
#: Of which family names are put together, by script. Fixed values.
SYLLABLES = {
    "latin": "ba be bo da de do ka ke ko la le lo ma me mo na",
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на",
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να",
}
_ALPHABET = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "han": "一二三四五六七八九十百千山水木火土金日月",
}

# With the lengths that mail allows: 64 before the @, 63 a label; so a long run of letters takes linear time.
_EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@(?:[\p{L}\p{N}-]{1,63}\.){1,10}\p{L}{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_IP6 = (
    r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"
)
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = (
    r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|(?<![0-9])(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
    # national numbers with a trunk 0, by groups: 2-2-2-2-2, 10 or 11 digits by hyphens, area and number
    r"|(?<![\p{L}\p{N}./-])0(?:[1-9](?:[\x20.-][0-9]{2}){4}|[0-9]-[0-9]{4}-[0-9]{4}|[0-9]{2}-[0-9]{3,4}-[0-9]{4}"
    r"|[0-9]{3}-[0-9]{2,3}-[0-9]{4}|[1-9][0-9]{1,3}[\x20/][0-9]{6,8})(?![0-9-])"
)
_CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])"
_TITLE = "(?:" + "|".join(sorted((t for g in TITLES.values() for t in g), key=len, reverse=True)) + ")"
# a possessive s is no part of the name; bounded, as groups that repeat without end overflow the stack
_WORD = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-](?![sS](?!\p{L}))\p{L}++){0,3}"
_ANNOUNCED = rf"{_TITLE}\.?\x20(?:\p{{Lu}}\.\x20?){{0,3}}"
_PERSON = rf"(?<![\p{{L}}\p{{N}}]){_ANNOUNCED}{_WORD}(?:\x20(?!{_TITLE}(?!\p{{L}})){_WORD})?"
#: All entities; of alternatives that begin at one place the first holds.
ENTITY = "|".join((_EMAIL, _IP, _IP6, _IBAN, _SSN, _PHONE, _CARD, _PERSON))
_HINT = rf"[0-9@]|{_TITLE}\.?\x20\p{{Lu}}"


@dataclass(frozen=True)
class PiiSpec:
    """``key`` decides the surrogates; whoever has it can link entities to them."""

    key: str = "change-me"
    most_attempts: int = 50


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def entities(text: Column) -> Column:
    """All mentions in order of place, without overlaps."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.rlike(text, F.lit(_HINT)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _kind(mention: Column) -> Column:
    digits = F.length(F.regexp_replace(mention, "[^0-9]", ""))
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(mention.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(mention.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(mention.rlike(r"\p{L}"), "person")
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(mention.rlike(r"^[+(]") | (digits < 13), "phone")
        .otherwise("card")
    )


def _gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, rf"^({_TITLE})\.?\x20", 1)
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("n")


def _canonical(mention: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind == "ip", mention)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def _name(mention: Column) -> Column:
    """Without title and initials."""
    return F.regexp_replace(mention, rf"^{_ANNOUNCED}", "")


def _people(mentions: Column) -> tuple[Column, Column]:
    """Of the titled mentions: all parts of names, and gender:given family of the full names."""
    titled = F.filter(mentions, lambda m: _kind(m) == "person")
    words = F.array_distinct(F.flatten(F.transform(titled, lambda m: F.split(F.lower(_name(m)), " "))))
    full = F.filter(titled, lambda m: _name(m).contains(" "))
    return words, F.array_distinct(F.transform(full, lambda m: F.concat(_gender(m), F.lit(":"), F.lower(_name(m)))))


def _with_words(words: Column) -> Column:
    """The pattern of the entities and of the name parts of a text, long ones first."""
    words = F.filter(words, lambda w: F.length(w) > 1)
    longest = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    parts = F.concat(
        F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    return F.when(F.size(words) > 0, parts).otherwise(F.lit(ENTITY))


def _one_gender(name: Column, own: Column, people: Column) -> Column:
    """The gender of a title, or of another mention of the full name if it has none."""
    return (
        F.when(own != "n", own)
        .when(F.array_contains(people, F.concat(F.lit("f:"), name)), "f")
        .when(F.array_contains(people, F.concat(F.lit("m:"), name)), "m")
        .otherwise("n")
    )


def _parts(mention: Column, people: Column, given: Column, families: Column) -> Column:
    """``before, items``: what stays of a mention, and the entities it consists of."""
    kind, name = _kind(mention), _name(mention)
    lower = F.lower(name)

    def item(kind: Column, canonical: Column, written: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"), written.alias("written"))

    first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    gender = _one_gender(lower, _gender(mention), people)
    full = F.array(
        item(F.lit("given"), F.concat(gender, F.lit(":"), F.lower(first)), first), item(F.lit("family"), F.lower(last), last)
    )
    alone = F.when(F.array_contains(families, lower), F.lit(None))
    for g in "fmn":
        as_given = F.concat(F.lit(f"{g}:"), lower)
        alone = alone.when(F.array_contains(given, as_given), as_given)
    single = F.array(item(F.when(alone.isNull(), "family").otherwise("given"), F.coalesce(alone, lower), name))
    person = F.when(name.contains(" "), full).otherwise(single)
    items = F.when(kind == "person", person).otherwise(F.array(item(kind, _canonical(mention, kind), mention)))
    before = F.when(kind == "person", F.regexp_extract(mention, rf"^({_ANNOUNCED})", 1)).otherwise("")
    return F.struct(before.alias("before"), items.alias("items"))


def _script(text: str) -> str:
    return f"CASE WHEN {text} RLIKE r'\\p{{IsCyrillic}}' THEN 'cyrillic' WHEN {text} RLIKE r'\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END"


def _byte(i: str) -> str:
    """The i-th of the digest's 32 bytes, moved on at each round through them."""
    return f"(CAST(conv(substring(digest, 1 + 2 * (({i}) % 32), 2), 16, 10) AS INT) + 7 * (({i}) div 32))"


def _filled(text: str) -> str:
    """Letters for letters of the same script and digits for digits."""
    cases = [f"WHEN c RLIKE '[0-9]' THEN CAST({_byte('i')} % 10 AS STRING)"]
    for script, test in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("han", r"\p{IsHan}"), ("latin", r"\p{L}")):
        letters = _ALPHABET[script]
        letter = f"substring('{letters}', 1 + {_byte('i')} % {len(letters)}, 1)"
        cases.append(f"WHEN c RLIKE r'{test}' THEN CASE WHEN c = lower(c) THEN {letter} ELSE upper({letter}) END")
    return f"array_join(transform(split({text}, ''), (c, i) -> CASE {' '.join(cases)} ELSE c END), '')"


def _luhn(digits: str) -> str:
    """Check sum, modulo 10, of a card number."""
    doubled = "2 * d - CASE WHEN d > 4 THEN 9 ELSE 0 END"
    values = f"transform(split(reverse({digits}), ''), (c, i) -> named_struct('d', CAST(c AS INT), 'i', i))"
    return f"(aggregate(transform({values}, x -> CASE WHEN x.i % 2 = 1 THEN {doubled.replace('d ', 'x.d ').replace('* d', '* x.d')} ELSE x.d END), 0, (t, x) -> t + x) % 10)"


def _check_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    digits = "CASE WHEN c RLIKE '[0-9]' THEN 10 * t + CAST(c AS INT) ELSE 100 * t + ascii(c) - 55 END"
    return f"lpad(CAST(98 - aggregate(split(concat({account}, {country}, '00'), ''), 0, (t, c) -> ({digits}) % 97) AS STRING), 2, '0')"


def _surrogates(entities_table: DataFrame, spec: PiiSpec) -> DataFrame:
    """Adds ``surrogate`` to rows of ``kind, canonical, attempt``."""
    secret = F.concat_ws("|", F.lit(spec.key), "kind", "canonical", F.col("attempt").cast("string"))
    table = entities_table.withColumn("digest", F.sha2(secret.cast("binary"), 256))
    # the domain of an address has a surrogate of its own, so that one domain stays one
    domain = F.regexp_extract("canonical", "@(.*)$", 1)
    table = table.withColumn("domain", F.sha2(F.concat_ws("|", F.lit(spec.key), F.lit("domain"), domain).cast("binary"), 256))
    half = "right(lpad(conv(substring(digest, {}, 15), 16, 10), 19, '0'), 18)"
    table = table.withColumn("digits", F.expr(f"concat({half.format(1)}, {half.format(16)})"))
    n = "length(canonical)"
    number = f"concat(left(canonical, kept), right(digits, {n} - kept))"
    card = f"CASE WHEN {_luhn('canonical')} = 0 THEN concat(left({number}, {n} - 1), CAST((10 - {_luhn(f'concat(left({number}, {n} - 1), chr(48))')}) % 10 AS STRING)) ELSE {number} END"
    local = "regexp_extract(canonical, r'^([^@]*)@', 1)"
    longer = "CASE WHEN attempt > 1 THEN substring(digest, 1, least(64, 2 * attempt)) ELSE '' END"
    email = f"concat({_filled(local)}, {longer}, '@', left(domain, 8), '.example.com')"
    octets = ", ".join(f"CAST(1 + {_byte(str(i))} % 254 AS STRING)" for i in range(4))
    ip6 = f"array_join(transform(split(canonical, ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE substring('0123456789abcdef', 1 + {_byte('i')} % 16, 1) END), '')"
    account = _filled("substring(canonical, 5)")
    iban = f"concat(left(canonical, 2), {_check_digits('left(canonical, 2)', account)}, {account})"
    first, family = [], []
    for (script, gender), names in FIRST_NAMES.items():
        first.append(f"WHEN script = '{script}' AND left(canonical, 1) = '{gender}' THEN split('{names}', ' ')[{_byte('0')} % 16]")
    for script, parts in SYLLABLES.items():
        family.append(
            f"WHEN script = '{script}' THEN array_join(transform(sequence(1, 5 + attempt), "
            f"i -> split('{parts}', ' ')[{_byte('i')} % 16]), '')"
        )
    family = f"CASE {' '.join(family)} END"
    # the names of the list are few: one that is taken is drawn again with syllables behind it
    given = f"concat(CASE {' '.join(first)} END, left({family}, 2 * attempt))"
    table = table.withColumn("script", F.expr(_script("canonical"))).withColumn(
        "kept", F.expr(f"CASE kind WHEN 'phone' THEN CASE WHEN canonical LIKE '0%' THEN 2 ELSE greatest(0, {n} - 10) END WHEN 'card' THEN 1 ELSE 0 END")
    )
    value = F.expr(
        f"CASE kind WHEN 'email' THEN {email} WHEN 'ip' THEN concat_ws('.', {octets}) WHEN 'iban' THEN {iban} "
        f"WHEN 'ip6' THEN {ip6} WHEN 'given' THEN {given} WHEN 'family' THEN initcap({family}) WHEN 'card' THEN {card} ELSE {number} END"
    )
    return table.select("kind", "canonical", "attempt", value.alias("surrogate"))


def assign_surrogates(known: DataFrame, spec: PiiSpec = PiiSpec()) -> DataFrame:
    """``kind, canonical, surrogate`` for the distinct rows of ``known (kind, canonical)``.

    In each round the entities without a surrogate draw one. It is theirs if no entity has it
    already, none of the texts is written like it, and no smaller entity drew it too.
    """
    known = write_table(known.distinct(), "entities")
    name = F.when(F.col("kind") == "given", F.substring("canonical", 3, 1_000_000)).otherwise(F.col("canonical"))
    taken = known.select("kind", name.alias("surrogate"))
    waiting, given = known.withColumn("attempt", F.lit(0)), None
    for _ in range(spec.most_attempts):
        drawn = _surrogates(waiting, spec)
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("winner"))
        blocked = taken.withColumn("blocked", F.lit(True)).distinct()
        if given is not None:
            blocked = blocked.unionByName(given.select("kind", F.lower("surrogate").alias("surrogate"), F.lit(True).alias("blocked"))).distinct()
        drawn = drawn.join(first, ["kind", "surrogate"]).withColumn("written", F.lower("surrogate"))
        blocked = blocked.select("kind", F.lower("surrogate").alias("written"), "blocked").distinct()
        drawn = drawn.join(blocked, ["kind", "written"], "left").withColumn(
            "good", F.col("blocked").isNull() & (F.col("canonical") == F.col("winner"))
        )
        drawn = write_table(drawn.select("kind", "canonical", "attempt", "surrogate", "good"), "surrogates")
        good = drawn.filter("good").select("kind", "canonical", "surrogate")
        given = good if given is None else given.unionByName(good)
        waiting = drawn.filter("NOT good").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if waiting.isEmpty():
            return given
    raise RuntimeError("surrogates of some entities still collide; there are too many of one form")


def _in_format(mention: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate written as the mention is: separators, spaces and capitals stay."""
    digit = F.aggregate(
        F.split(mention, ""),
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(1).alias("i")),
        lambda t, c: F.when(
            c.rlike("[A-Z0-9]"),
            F.struct(F.concat(t["out"], F.array(F.substring(surrogate, t["i"], F.lit(1)))).alias("out"), (t["i"] + 1).alias("i")),
        ).otherwise(F.struct(F.concat(t["out"], F.array(c)).alias("out"), t["i"].alias("i"))),
        lambda t: F.array_join(t["out"], ""),
    )
    capitals = (F.length(mention) > 1) & (mention == F.upper(mention))
    name = F.when(capitals, F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("email", "ip", "ip6"), surrogate).when(kind.isin("given", "family"), name).otherwise(digit)


def _found(docs: DataFrame) -> DataFrame:
    """Texts with mentions: ``doc, _row, n_entities, _items``, and ``_pieces``, what stays before each item."""
    text, people = F.col("doc.text").cast("string"), F.col("_people")
    words, full = _people(F.col("_mentions"))
    docs = docs.select("doc", "_mentions", _with_words(words).alias("_pattern"), full.alias("_people"))
    again = F.regexp_extract_all(text, F.col("_pattern"), F.lit(0))
    name = F.transform(people, lambda p: F.struct(F.left(p, F.lit(1)).alias("own"), F.substring(p, 3, 1_000_000).alias("name")))
    given = F.transform(
        name, lambda p: F.concat(_one_gender(p["name"], p["own"], people), F.lit(":"), F.substring_index(p["name"], " ", 1))
    )
    docs = docs.select(
        "doc",
        "_pattern",
        "_people",
        F.when(F.col("_pattern") == ENTITY, F.col("_mentions")).otherwise(again).alias("_mentions"),
        F.array_distinct(given).alias("_given"),
        F.array_distinct(F.transform(people, lambda p: F.substring_index(p, " ", -1))).alias("_families"),
    )
    parts = F.transform("_mentions", lambda m: _parts(m, people, F.col("_given"), F.col("_families")))
    docs = docs.withColumn("_parts", parts)
    between = F.zip_with(
        F.split(text, F.col("_pattern"), -1),
        "_parts",
        lambda piece, part: F.when(part.isNull(), F.array(piece))
        .when(F.size(part["items"]) == 2, F.array(F.concat(piece, part["before"]), F.lit(" ")))
        .otherwise(F.array(F.concat(piece, part["before"]))),
    )
    return docs.select(
        "doc",
        F.monotonically_increasing_id().alias("_row"),
        F.size("_mentions").alias("n_entities"),
        F.flatten(F.transform("_parts", lambda p: p["items"])).alias("_items"),
        F.flatten(between).alias("_pieces"),
    )


def replace_pii(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_entities``, the number of mentions.

    Mentions are counted as they are written: a title with its name is one, and so is each part of a
    name without title in a text that announces the person. All other columns are kept; an
    ``n_entities`` column of the input is replaced. A null text stays null and has none, an empty one
    stays empty. Rows are treated alike whatever their doc_id, repeated or null. An empty table
    gives no rows.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    # the columns of the input stay in one struct, apart from those of the work
    docs = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), entities(F.col("text")).alias("_mentions"))
    plain = docs.filter("size(_mentions) = 0").select("doc.*", F.lit(0).alias("n_entities"))
    found = write_table(_found(docs.filter("size(_mentions) > 0")), "found")
    mentions = write_table(found.select("_row", F.posexplode("_items").alias("_place", "m")).select("_row", "_place", "m.*"), "mentions")
    given = assign_surrogates(mentions.select("kind", "canonical"), spec)
    written = mentions.join(given, ["kind", "canonical"]).select(
        "_row", F.struct("_place", _in_format(F.col("written"), F.col("kind"), F.col("surrogate")).alias("new")).alias("m")
    )
    written = written.groupBy("_row").agg(F.sort_array(F.collect_list("m")).alias("_new"))
    rows = found.join(written, "_row")
    woven = F.array_join(F.flatten(F.zip_with("_pieces", F.col("_new.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    kept = [woven.alias(n) if n == "text" else F.col("doc").getField(n).alias(n) for n in names]
    return plain.unionByName(rows.select(*kept, "n_entities"))
