"""Surrogates for personal data, in DataFrame operations only.

One pattern finds the entities: e-mail and IP addresses, telephone and card numbers, social security numbers, bank
accounts, and names after a title. An entity is what its spellings share: a mail address in lower case, the letters and
digits of a number, the first and the family name each on their own, without the title. It gets a surrogate that depends
on a secret key and on that, and every mention shows it in the mention's own format: a
letter becomes a letter of the same case, script and kind (vowels stay vowels, so names can be spoken), a digit a digit,
anything else stays; first names come from lists by the gender of the title and the script, if there are any for it; card numbers keep a right check
digit; the ends of mail domains, country and area formats stay. The same entity has the same surrogate in all documents.

Distinctness is checked: where surrogates of several entities coincide, or equal an entity that occurs, all but the
least of those entities draw again with the next attempt, until none is left; after some attempts, names, mail addresses
and telephone numbers get longer. Formats of fixed length cannot: if their values run out, drawing fails with an error. Surrogates are made once per distinct entity.
Only texts with an entity take part in a join; the others pass by.

A null text has no entities and stays null; an empty one stays empty; repeated rows are changed alike; other columns are
ignored. Text without entities comes out byte for byte as it was.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.staging import identified
from hourgrid.session import materialize

KEY = "surrogate key of this corpus"
#: The attempt from which on surrogates may be longer than their entity.
WIDER = 4
MALE_TITLES, FEMALE_TITLES, OTHER_TITLES = r"Mr|Herr|Señor|Sr|Monsieur|г-н", r"Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа", r"Dr|Prof"
#: Names by gender and script.
NAMES = {
    ("male", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noel Oscar Paul Quentin Robert Simon Tomas Urban Victor Walter Xaver Yann".split(),
    ("female", "latin"): "Anna Berta Clara Diana Emma Frida Greta Hanna Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Tilda Ursula Vera Wanda Xenia Yvonne Zoe".split(),
    ("other", "latin"): "Abel Blake Casey Dana Eden Frankie Gale Harper Indigo Jamie Kim Lou Morgan Nico Olive Parker Quinn Robin Sasha Taylor Uma Val Winter Yael Zion".split(),
    ("male", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Николай Олег Павел Роман Сергей".split(),
    ("female", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина".split(),
    ("other", "cyrillic"): "Аким Блок Воля Груша Дон Заря Ива Клён Лев Мир Нева Осень Путь Роща Сад".split(),
}
_TITLED = rf"(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OTHER_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?)(?![\p{{L}}])"
#: The kinds of entities in the order in which they are tried.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63})*\.[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9.]*[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"[3-6][0-9]{3}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])",
    "name": _TITLED,
}
ENTITY = r"(?<![\p{L}0-9._%+@\-])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_GROUPS = (_DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "áéíóú", "àèìòù", "äöü")


def _scripts() -> list[tuple[str, str]]:
    """By script and case, the letters that are in no group, and those without marks, from which theirs are drawn."""
    listed, found = {c for g in _GROUPS for c in g}, {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(c) in ("Lu", "Ll") and c not in listed:
            name = unicodedata.name(c)
            members, plain = found.setdefault((name.split()[0], unicodedata.category(c)), ([], []))
            members.append(c)
            if " LETTER " in name and " WITH " not in name:
                plain.append(c)
    for (script, case), (_, plain) in found.items():
        if script in ("LATIN", "CYRILLIC"):
            plain[:] = {"LATINLu": _GROUPS[4], "LATINLl": _GROUPS[2], "CYRILLICLu": _GROUPS[8], "CYRILLICLl": _GROUPS[6]}[script + case]
    return [("".join(members), "".join(plain if len(plain) > 1 else members)) for members, plain in found.values()]


#: All letters and digits, for each the number of its list as a character, and what each list draws from.
_ALL = [*((g, g) for g in _GROUPS), *_scripts()]
_LETTERS, _NUMBERS = "".join(m for m, _ in _ALL), "".join(chr(33 + k) * len(m) for k, (m, _) in enumerate(_ALL))
#: The attempt after which drawing fails: then all values of a format, such as social security numbers, are in use.
LAST = 200


def kind_of(entity: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(F.rlike(entity, F.lit(f"^(?:{pattern})$")), name).otherwise(kind)
    return kind


def _stream(entity: Column, attempt: Column, key: str) -> Column:
    """Hexadecimal digits, two for each character, that depend on key, entity and attempt."""
    blocks = F.sequence(F.lit(0), F.ceil(F.length(entity) / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), entity, attempt.cast("string"), b.cast("string")), 256)), "")


def _number(stream: Column, place: Column) -> Column:
    return F.conv(F.substring(stream, 2 * place + 1, 2), 16, 10).cast("int")


def _replaced(character: Column, number: Column) -> Column:
    """Another character of the same group, or else of the same script and case; no letter or digit stays as it is."""
    place = F.position(character, F.lit(_LETTERS))
    known = F.element_at(F.array(*[F.lit(p) for _, p in _ALL]), F.ascii(F.substring(F.lit(_NUMBERS), place, F.lit(1))) - 32)
    # a letter that is in no list gets a Latin one
    drawn_from = F.when(place > 0, known).when(F.rlike(character, F.lit(r"^\p{Lu}")), _GROUPS[4]).when(F.rlike(character, F.lit(r"^\p{Ll}")), _GROUPS[2]).otherwise(character)
    return F.substring(drawn_from, number % F.length(drawn_from) + 1, F.lit(1))


def _named(value: Column, use) -> Column:
    """``use`` of the value, which is computed, and stands in the plan, only once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _spelled(text: Column, stream: Column, first: Column, end: Column) -> Column:
    """The text with its characters from place ``first`` to before ``end`` replaced."""
    places = F.sequence(F.lit(0), F.length(text) - 1)
    letter = lambda p: F.substring(text, p + 1, F.lit(1))
    return F.array_join(F.transform(places, lambda p: F.when((p < first) | (p >= end), letter(p)).otherwise(_replaced(letter(p), _number(stream, p)))), "")


def _checked(card: Column) -> Column:
    """The card number with its last digit set so that the Luhn sum is right."""
    digits = F.regexp_replace(card, "[^0-9]", "")
    body = F.reverse(F.substring(digits, F.lit(1), F.length(digits) - 1))
    value = lambda p: F.substring(body, p + 1, F.lit(1)).cast("int")
    doubled = lambda p: F.when(p % 2 == 0, F.when(value(p) * 2 > 9, value(p) * 2 - 9).otherwise(value(p) * 2)).otherwise(value(p))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(body) - 1), doubled), F.lit(0), lambda a, x: a + x)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), ((10 - total % 10) % 10).cast("string"))


def _luhn(card: Column) -> Column:
    return _checked(card) == card


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(F.rlike(bare, F.lit(f"^(?:{MALE_TITLES})$")), "male").when(F.rlike(bare, F.lit(f"^(?:{FEMALE_TITLES})$")), "female").otherwise("other")


def _first_name(name: Column, part: Column, stream: Column, spelled: Column) -> Column:
    """A listed name of the gender of ``part`` and of the script of ``name``; where the script has none, the spoken word ``spelled``."""
    script = F.when(F.rlike(name, F.lit(r"^\p{IsCyrillic}")), "cyrillic").when(F.rlike(name, F.lit(r"^\p{IsLatin}")), "latin")
    chosen, number = spelled, F.conv(F.substring(stream, F.lit(1), F.lit(6)), 16, 10).cast("int")
    for (g, s), names in NAMES.items():
        listed = F.array(*[F.lit(n) for n in names])
        chosen = F.when((part == f"first {g}") & script.eqNullSafe(s), F.element_at(listed, number % len(names) + 1)).otherwise(chosen)
    return chosen


def _marks(entity: Column) -> Column:
    return F.regexp_replace(entity, "[^A-Za-z0-9]", "")


def normalised(entity: Column, kind: Column) -> Column:
    """What all spellings of an entity other than a name share."""
    marks = _marks(entity)
    # numbers of country 1 are also written without it
    phone = F.when(~F.startswith(entity, F.lit("+")), marks).when(F.rlike(marks, F.lit("^1[0-9]{10}$")), F.substring(marks, 2, 10)).otherwise(F.concat(F.lit("+"), marks))
    return F.when(kind == "email", F.lower(entity)).when(kind == "phone", phone).when(kind == "ip", entity).otherwise(marks)


def _more(last: Column, part: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Further characters like ``last`` from attempt ``WIDER`` on, one more with each attempt."""
    stream = _stream(F.concat(F.lit("wider|"), part, F.lit("|"), norm), attempt, key)
    places = F.sequence(F.lit(0), F.least(attempt - WIDER, F.lit(11)))
    letter = lambda p: _replaced(last, _number(stream, p))
    return F.when(attempt < WIDER, "").otherwise(F.array_join(F.transform(F.when(attempt >= WIDER, places), letter), ""))


def surrogate(norm: Column, part: Column, attempt: Column, key: str = KEY) -> Column:
    """The drawn value, in normalised form, of a part of an entity.

    All kinds are spelled by one expression: its lists of letters are long, and plans that repeat them fill the driver.
    """
    at, ending = F.locate("@", norm), F.length(norm) - F.length(F.substring_index(norm, ".", -1)) - 1
    first = F.when(part == "card", 1).when((part == "iban") | ((part == "phone") & F.startswith(norm, F.lit("+"))), 2).otherwise(0)
    end = F.when(part == "email", ending).when(part == "ip", 0).otherwise(F.length(norm))
    last = F.when(part == "email", "b").when(part == "phone", "0").otherwise(F.right(norm, F.lit(1)))

    def chosen(stream: Column, spelled: Column, more: Column) -> Column:
        octets = F.transform(F.split(norm, r"\."), lambda o, i: (_number(stream, 4 * i) * 256 + _number(stream, 4 * i + 1)) % 223 + 1)
        return (
            F.when(part == "email", F.concat(F.substring(spelled, F.lit(1), at - 1), more, F.substring(spelled, at, F.length(spelled))))
            .when(part == "ip", F.array_join(octets.cast("array<string>"), "."))
            .when(part == "card", F.when(_luhn(norm), _checked(spelled)).otherwise(spelled))
            .when((part == "phone") | (part == "family"), F.concat(spelled, more))
            .when(F.startswith(part, F.lit("first")), F.concat(_first_name(norm, part, stream, spelled), more))
            .otherwise(spelled)
        )

    return _named(
        _stream(F.concat(part, F.lit("|"), norm), attempt, key),
        lambda stream: _named(
            F.struct(_spelled(norm, stream, first, end).alias("spelled"), _more(last, part, norm, attempt, key).alias("more")),
            lambda drawn: chosen(stream, drawn["spelled"], drawn["more"]),
        ),
    )


def _like_mail(entity: Column, drawn: Column) -> Column:
    """The drawn address with capitals where the mention has them."""
    at, more = F.locate("@", entity) - 1, F.length(drawn) - F.length(entity)

    def letter(p: Column) -> Column:
        own = F.when(p < at, F.substring(entity, p + 1, F.lit(1))).when(p < at + more, "").otherwise(F.substring(entity, p - more + 1, F.lit(1)))
        drawn_one = F.substring(drawn, p + 1, F.lit(1))
        return F.when(F.rlike(own, F.lit("[A-Z]")), F.upper(drawn_one)).otherwise(drawn_one)

    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(drawn) - 1), letter), "")


def _like_number(entity: Column, norm: Column, drawn: Column) -> Column:
    """The drawn letters and digits between the other characters of the mention; a country code that ``norm`` lacks stays."""
    drawn, size = F.ltrim(drawn, F.lit("+")), F.length(F.ltrim(norm, F.lit("+")))
    skip = F.length(_marks(entity)) - size

    def letter(p: Column) -> Column:
        own, before = F.substring(entity, p + 1, F.lit(1)), F.length(_marks(F.substring(entity, F.lit(1), p)))
        return F.when(F.rlike(own, F.lit("[A-Za-z0-9]")) & (before >= skip), F.substring(drawn, before - skip + 1, F.lit(1))).otherwise(own)

    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.length(entity) - 1), letter), ""), F.substring(drawn, size + 1, F.lit(64)))


def parts_of(entities: DataFrame) -> DataFrame:
    """``entity, kind, place, part, norm``: names in their first and family name, others as one part.

    A first name after a title of no gender has the gender that titles give it elsewhere, if that is only one.
    """
    words = F.split("entity", " ")
    pair = lambda place, part, norm: F.struct(F.lit(place).alias("place"), part.alias("part"), norm.alias("norm"))
    family = pair(1, F.lit("family"), F.element_at(words, -1))
    first = pair(0, F.concat(F.lit("first "), _gender(F.element_at(words, 1))), F.element_at(words, 2))
    kind = F.col("kind")
    parts = F.when(kind != "name", F.array(pair(0, kind, normalised(F.col("entity"), kind)))).when(F.size(words) > 2, F.array(first, family)).otherwise(F.array(family))
    spread = materialize(entities.select("entity", kind_of(F.col("entity")).alias("kind")).select("entity", "kind", F.inline(parts)), "parts")
    told = spread.where("part IN ('first male', 'first female')").groupBy("norm").agg(F.min("part").alias("told"), F.max("part").alias("most")).where("told = most").select("norm", "told")
    open_ones = spread.where("part = 'first other'").join(told, "norm", "left")
    return spread.where("part <> 'first other'").unionByName(open_ones.select("entity", "kind", "place", F.coalesce("told", "part").alias("part"), "norm"))


def _drawn(parts: DataFrame, key: str) -> DataFrame:
    """``part, norm, surrogate`` of distinct parts; those of one kind have different surrogates.

    No surrogate is a part that occurs; a first name's is only another one than its own, as family names differ anyway.
    """
    settled, attempt = None, 0
    real = parts.where("NOT startswith(part, 'first')").select(F.col("part").alias("group"), F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    group = F.element_at(F.split("part", " "), 1).alias("group")
    drawn = parts.select("part", "norm", F.lit(0).alias("attempt"))
    # drawing takes long for its few bytes, so that its tasks are not merged by size
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        drawn = drawn.repartition(tasks, "norm").select("part", "norm", "attempt", surrogate(F.col("norm"), F.col("part"), F.col("attempt"), key).alias("surrogate"), group)
        drawn = materialize(drawn if settled is None else settled.unionByName(drawn), "surrogates")
        first = drawn.groupBy("group", "surrogate").agg(F.min(F.struct("attempt", "norm", "part")).alias("first"), F.count("*").alias("n"), F.max(F.col("surrogate") == F.col("norm")).alias("own"))
        clashes = first.join(real, ["group", "surrogate"], "left").where("n > 1 OR own OR real")
        clashes = materialize(clashes.select("group", "surrogate", F.struct("first.norm", "first.part").alias("owner"), F.coalesce("real", F.lit(False)).alias("real")), "clashes")
        if clashes.isEmpty():
            return drawn.select("part", "norm", "surrogate")
        judged = drawn.join(clashes, ["group", "surrogate"], "left")
        loses = F.coalesce(F.col("real") | (F.struct("norm", "part") != F.col("owner")) | (F.col("surrogate") == F.col("norm")), F.lit(False))
        settled = judged.where(~loses).select("part", "norm", "attempt", "surrogate", "group")
        attempt += 1
        if attempt > LAST:
            raise ValueError(f"some entities have no surrogate after {LAST} attempts: {[tuple(r) for r in judged.where(loses).groupBy('part').count().collect()]}")
        drawn = judged.where(loses).select("part", "norm", (F.col("attempt") + 1).alias("attempt"))


def surrogates_of(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``entity, kind, surrogate`` of distinct ``entity``; no two surrogates are equal, and none is an entity."""
    parts = materialize(parts_of(entities), "parts")
    drawn = _drawn(materialize(parts.select("part", "norm").distinct(), "distinct"), key)
    whole = parts.join(drawn, ["part", "norm"]).groupBy("entity", "kind").agg(F.array_sort(F.collect_list(F.struct("place", "norm", "surrogate"))).alias("parts"))
    entity, kind, one = F.col("entity"), F.col("kind"), F.element_at("parts", 1)
    name = F.array_join(F.concat(F.array(F.substring_index(entity, " ", 1)), F.col("parts.surrogate")), " ")
    said = F.when(kind == "name", name).when(kind == "email", _like_mail(entity, one["surrogate"])).when(kind == "ip", one["surrogate"])
    return whole.select("entity", "kind", said.otherwise(_like_number(entity, one["norm"], one["surrogate"])).alias("surrogate"))


def replace_entities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """``doc_id, n_entities, text`` of every row, its entities replaced."""
    row = ["row_id", "row_hash"]
    found = identified(docs, doc_id, text).withColumn("entities", F.coalesce(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.array().cast("array<string>")))
    spread = materialize(found.where(F.size("entities") > 0).select(*row, F.explode(F.array_distinct("entities")).alias("entity")).distinct(), "entities")
    mapping = materialize(surrogates_of(spread.select("entity").distinct(), key), "mapping")
    own = spread.join(mapping, "entity").groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("own"))
    between = F.split("text", F.lit(ENTITY), F.lit(-1))
    pieces = F.transform("between", lambda part, i: F.concat(part, F.coalesce(F.col("own")[F.get("entities", i)], F.lit(""))))
    with_own = found.where(F.size("entities") > 0).join(own, row).withColumn("between", between)
    changed = with_own.select("doc_id", F.size("entities").alias("n_entities"), F.array_join(pieces, "").alias("text"))
    untouched = found.where(F.size("entities") == 0).select("doc_id", F.lit(0).alias("n_entities"), "text")
    return changed.unionByName(untouched)
