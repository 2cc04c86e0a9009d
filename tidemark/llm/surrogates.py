"""Surrogates for personal data, with DataFrame functions only.

Detected entities (e-mail, IP, phone and social-security numbers, bank accounts, cards and other long numbers, secrets, titled names) are
replaced with others of the same type and format, derived from a key. What is replaced is an entity's parts, without regard to how they are
written: the digits of a number, the name and the host of an address, the given and the family name. The same part gets the same surrogate
everywhere, so that other spellings of a number, and Mr. Smith and Mr. John Smith, still belong together. A name that a title tells is also
replaced where it stands in the same text without a title. Surrogates are checked over all texts: no two parts of a kind share one, and
none is itself such a part of the texts; those that would are derived again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.fingerprints import let

# Titles by gender, and letters and name parts by script.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Señora|Señorita|Sra|Madame|Mademoiselle|Mme|Mlle|Госпожа|Κυρία", "m": "Mr|Mister|Herr|Señor|Sr|Monsieur|Господин|Κύριος", "n": "Mx|Dr|Prof|Professor"}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя"}
SYLLABLES = {
    "latin": "ba be bri ca cor da del do fa fi ga ger ha hel jo ka ke la lin lo ma mar me na ni ol pa per ra ri ro sa sel so ta te tor va vi wen".split(),
    "greek": "αλ αν βα γε δη δω ελ ζη ηλ θε ιω κα κλ λα λε μα με νι ξε ορ πα πε ρο σα σο τα τι φι χα χρ".split(),
    "cyrillic": "ал ан бо ва ве га да де ди ев жа за зи ив ка ки ла ле ли ма ми на ни ол па пе ра ри ро са се та ти фе".split(),
}
ENDINGS = {
    ("latin", "f"): ("ina", "ana", "elle", "ia"), ("latin", "m"): ("ard", "us", "on", "ric"), ("latin", "n"): ("en", "in", "is", "er"),
    ("greek", "f"): ("ία", "ίνα", "ούλα", "ώ"), ("greek", "m"): ("ος", "ας", "ης", "ων"), ("greek", "n"): ("ις", "ι", "ω", "ες"),
    ("cyrillic", "f"): ("ина", "ана", "ья", "ира"), ("cyrillic", "m"): ("ан", "ил", "ей", "ор"), ("cyrillic", "n"): ("ен", "ин", "ик", "ер"),
}
FAMILY = {"latin": ("son", "man", "ley", "ter"), "greek": ("ίδης", "άκης", "όπουλος", "ιάδης"), "cyrillic": ("енко", "чук", "ман", "ян")}

_EDGE, _STOP = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_TITLE = "|".join(TITLES.values())
#: A host has at most 127 labels, as in DNS; a bound also keeps the matcher's recursion short.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,126}\p{L}{2,}"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\d)"
IBAN = _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _STOP
SECRET = _EDGE + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{30,80}|sk-[A-Za-z0-9]{20,80})" + _STOP
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[.-])\d{3}[ .-]?\d{4}" + _STOP + r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}" + _STOP
SSN = _EDGE + r"\d{3}-\d{2}-\d{4}" + _STOP
NUMBER = _EDGE + r"\d(?:[ -]?\d){8,18}" + _STOP
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
#: All entities; where several begin at one place, the first named wins. What a place begins with tells which of them can begin there.
ENTITY = rf"{EMAIL}|(?=[0-9+(])(?:{IP}|{SECRET}|{SSN}|{PHONE}|{NUMBER})|(?=[A-Z]){IBAN}|(?=[a-gsA-F])(?:{SECRET})|(?=\p{{Lu}}){NAME}"
#: A text without one of these holds no entity: digits and @, secrets without digits, titles. Few letters begin a title or a secret, so most
#: places of a text are passed after one look.
HINT = (
    rf"[0-9@]|(?=[{''.join(sorted({t[0] for t in _TITLE.split('|')}))}])(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}"
    rf"|(?=[a-gsA-F]){_EDGE}(?:sk-[A-Za-z]{{20}}|gh[oprsu]_[A-Za-z]{{30}}|AKIA[A-Z]{{16}}|[a-f]{{32}}|[A-F]{{32}})"
)


def _draw(digest: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(digest, place), F.lit(n)).cast("int")


def _letter(letters: Column, digest: Column, place: Column) -> Column:
    return F.substring(letters, F.pmod(F.xxhash64(digest, place), F.length(letters)).cast("int") + 1, F.lit(1))


def _chars(text: Column) -> Column:
    return F.array_remove(F.split(text, ""), "")


def same_format(value: Column, digest: Column, hexadecimal: Column) -> Column:
    """Other digits for digits and other letters for letters, of the same case and script; all else as it is."""
    low = F.when(hexadecimal, ALPHABETS["latin"][:6]).otherwise(ALPHABETS["latin"])

    def other(c: Column, i: Column) -> Column:
        letters = F.when(c.rlike(r"\p{IsGreek}"), ALPHABETS["greek"]).when(c.rlike(r"\p{IsCyrillic}"), ALPHABETS["cyrillic"]).otherwise(low)
        letter = _letter(letters, digest, i)
        return F.when(c.rlike(r"\p{N}"), _letter(F.lit("0123456789"), digest, i)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(_chars(value), other), "")


def _luhn(digits: Column) -> Column:
    """The sum whose remainder by 10 is 0 for valid card numbers."""
    one = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(one, F.lit(0), lambda a, x: a + x)


# Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: From this turn on surrogates are a character longer in each turn, and octets of any width: a kind whose values are used up gets new ones.
WIDER = 3
#: From this turn on an address gets further octets, should the texts hold nearly all there are.
FIFTH_OCTET = 40


def _checked_number(value: Column, other: Column) -> Column:
    """Digits with the check digit of a card number, if ``value`` has a valid one."""
    body = F.substring(other, F.lit(1), F.length(other) - 1)
    checked = F.concat(body, F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    return F.when((F.length(value) >= 13) & ~value.startswith("+") & (_luhn(value) % 10 == 0), checked).otherwise(other)


def _checked_iban(country: Column, rest: Column) -> Column:
    numbers = _chars(F.array_join(F.transform(_chars(F.concat(rest, country, F.lit("00"))), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), ""))
    check = F.lit(98) - F.aggregate(numbers, F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _ip(value: Column, digest: Column, turn: Column) -> Column:
    def other(o: Column, i: Column) -> Column:
        same = F.when(F.length(o) == 1, _draw(digest, i, 9) + 1).when(F.length(o) == 2, _draw(digest, i, 90) + 10).otherwise(_draw(digest, i, 155) + 100)
        return F.when(turn > WIDER, _draw(digest, i, 255) + 1).otherwise(same).cast("string")

    octets = F.transform(F.split(value, r"\."), other)
    more = F.when(turn > FIFTH_OCTET, F.transform(F.sequence(F.lit(4), turn - FIFTH_OCTET + 3), lambda i: (_draw(digest, i, 255) + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(octets, more), ".")


def _pick(choices: tuple | list, digest: Column, place: Column) -> Column:
    return F.get(F.split(F.lit(" ".join(choices)), " "), _draw(digest, place, len(choices)))


def _name(value: Column, digest: Column, turn: Column, gender: Column | None) -> Column:
    """A name of the same script: a family name, or a given name of a gender. Null for other scripts."""
    out = None
    for script, block in (("greek", "Greek"), ("cyrillic", "Cyrillic"), ("latin", "Latin")):
        # Two syllables for a given name and three for a family name, and another for each late turn.
        some = F.sequence(F.lit(1), F.greatest(F.lit(0), turn - WIDER) + (2 if gender is not None else 3))
        made = F.array_join(F.transform(some, lambda i: _pick(SYLLABLES[script], digest, i)), "")  # noqa: B023
        if gender is None:
            end = _pick(FAMILY[script], digest, F.lit(0))
        else:
            end = F.when(gender == "f", _pick(ENDINGS[script, "f"], digest, F.lit(0))).when(gender == "m", _pick(ENDINGS[script, "m"], digest, F.lit(0))).otherwise(_pick(ENDINGS[script, "n"], digest, F.lit(0)))
        here = value.rlike(rf"^\p{{Is{block}}}")
        out = F.when(here, F.initcap(F.concat(made, end))) if out is None else out.when(here, F.initcap(F.concat(made, end)))
    return out


def surrogate(kind: Column, part: Column, gender: Column, turn: Column, key: str) -> Column:
    """The surrogate of a part in a turn: another turn gives another one, and late turns longer ones, so that there are always more to take.

    What stays: the country code or else first digit of a number, the country of an account, what tells a key's kind, a top-level domain.
    """
    first = F.when(part.startswith("+"), F.regexp_extract(part, COUNTRY, 0)).otherwise(F.substring(part, 1, 1))
    before = F.when(kind == "digits", first).when(kind == "iban", F.substring(part, 1, 2)).when(kind == "secret", F.regexp_extract(part, "^(AKIA|gh[oprsu]_|sk-)", 1)).otherwise("")
    after = F.when(kind == "host", F.regexp_extract(part, r"(\.\p{L}+)$", 1)).otherwise("")
    skipped = F.length(before) + F.when(kind == "iban", 2).otherwise(0)  # and its check digits
    body = F.substring(part, skipped + 1, F.length(part) - skipped - F.length(after))
    hexadecimal = (kind == "secret") & part.rlike("^[0-9a-fA-F]+$")
    letters = F.when(kind.isin("digits", "iban"), "0123456789").when(hexadecimal & part.rlike("[A-F]"), "ABCDEF").when(hexadecimal, "abcdef").otherwise(ALPHABETS["latin"])
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, part, turn.cast("string")), 256)
    drawn = F.struct(digest.alias("d"), before.alias("before"), after.alias("after"), body.alias("body"), letters.alias("letters"), hexadecimal.alias("hex"))

    def made(x: Column) -> Column:
        late = F.when(turn > WIDER, F.sequence(F.lit(1), turn - WIDER)).otherwise(F.array().cast("array<int>"))
        longer = F.array_join(F.transform(late, lambda i: _letter(x["letters"], x["d"], i + 1_000_000)), "")
        return F.struct(x["d"].alias("d"), x["before"].alias("before"), F.concat(same_format(x["body"], x["d"], x["hex"]), longer, x["after"]).alias("rest"))

    def finished(x: Column) -> Column:
        whole = F.concat(x["before"], x["rest"])
        name = F.coalesce(F.when(kind == "family", _name(part, x["d"], turn, None)).when(kind == "given", _name(part, x["d"], turn, gender)), whole)
        return F.when(kind == "digits", _checked_number(part, whole)).when(kind == "ip", _ip(part, x["d"], turn)).when(kind == "iban", _checked_iban(x["before"], x["rest"])).otherwise(name)

    return let(let(drawn, made), finished)


def value_parts(value: Column) -> Column:
    """An entity's parts, as they are compared: an array of kind, part, gender (of given names only).

    Digits of social-security, phone and other numbers are one kind: how they are set apart doesn't matter.
    """

    def of(kind: str, part: Column, gender: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), part.alias("part"), (F.lit(None).cast("string") if gender is None else gender).alias("gender"))

    def is_(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    title = F.regexp_extract(value, r"^(\p{L}+)\.? ", 1)
    gender = F.when(title.rlike(f"^(?:{TITLES['f']})$"), "f").when(title.rlike(f"^(?:{TITLES['m']})$"), "m").otherwise("n")
    family = of("family", F.regexp_extract(value, r"(\p{L}+)$", 1))
    given = of("given", F.regexp_extract(value, r" (\p{L}+) \p{L}+$", 1), gender)
    name = F.when(value.rlike(r" \p{L}+ \p{L}+$"), F.array(given, family)).otherwise(F.array(family))
    address = F.array(of("local", F.lower(F.substring_index(value, "@", 1))), of("host", F.lower(F.substring_index(value, "@", -1))))
    return (
        F.when(value.contains("@"), address).when(is_(IP), F.array(of("ip", value))).when(value.rlike(r"^\p{L}+\.? \p{Lu}"), name).when(is_(IBAN), F.array(of("iban", F.replace(value, F.lit(" "), F.lit("")))))
        .when(is_(SECRET), F.array(of("secret", value))).otherwise(F.array(of("digits", F.regexp_replace(value, "[^0-9+]", ""))))
    )


def _cased(c: Column, like: Column) -> Column:
    return F.when(like.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)


def _poured(value: Column, other: Column) -> Column:
    """Letters and digits of ``other`` where ``value`` has some, and what is left of them after it. For values of a bounded length."""
    own = F.regexp_replace(other, r"[^\p{L}\p{N}]", "")
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("i"))
    step = lambda a, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(a["t"], F.substring(own, a["i"] + 1, F.lit(1))).alias("t"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["i"].alias("i")))
    return F.aggregate(_chars(value), start, step, lambda a: F.concat(a["t"], F.substring(own, a["i"] + 1, F.length(own))))


def _like(value: Column, other: Column) -> Column:
    """``other`` in the case of ``value``, place by place."""
    return let(_chars(value), lambda own: F.array_join(F.transform(_chars(other), lambda c, i: _cased(c, F.coalesce(F.get(own, i), F.lit("")))), ""))


def rendered(value: Column, kinds: Column, made: Column) -> Column:
    """An entity's surrogate: its parts' surrogates, ``made``, written as the entity is."""
    kind, one, two = kinds[0], made[0], F.get(made, F.lit(1))
    address = F.concat(_like(F.substring_index(value, "@", 1), one), F.lit("@"), _like(F.substring_index(value, "@", -1), two))
    name = F.concat(F.regexp_extract(value, r"^(\p{L}+\.? )", 1), F.concat_ws(" ", made))
    return F.when(kind == "local", address).when(kind.isin("given", "family"), name).when(kind.isin("digits", "iban"), _poured(value, one)).otherwise(one)


def find_entities(docs: DataFrame) -> DataFrame:
    """_k1, _k2, place, value: the entities of each different text, which two hashes stand for, in order from place 0."""
    found = docs.where(F.col("text").rlike(HINT)).select(*_text_keys(), F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), 0)).alias("place", "value"))
    return found.distinct()


def _text_keys() -> list[Column]:
    return [F.xxhash64("text").alias("_k1"), F.xxhash64("text", F.lit(1)).alias("_k2")]


def surrogate_table(parts: DataFrame, key: str, derive=surrogate) -> DataFrame:
    """kind, part, surrogate for each row of kind, part, gender (one a part).

    In each turn the parts that have no surrogate yet get one. It is kept unless it is itself a part of its kind, is taken already, or a
    smaller part gets the same in this turn. Only parts without one take another turn. Since surrogates grow by a character a turn after
    the first few, a turn in which most are free comes for any number of parts. ``derive(kind, part, gender, turn, key)`` makes them.
    """
    names = parts.select("kind", F.col("part").alias("surrogate"))
    left, done, turn = parts, None, 0
    while True:
        drawn = left.withColumn("surrogate", derive(F.col("kind"), F.col("part"), F.col("gender"), F.lit(turn), key))
        drawn = cut(drawn)
        taken = names if done is None else names.unionByName(done.select("kind", "surrogate"))
        # Which of this turn's surrogates are taken: the side that turns make small is looked up in all, not the reverse.
        wanted = drawn.groupBy("kind", "surrogate").agg(F.min("part").alias("first"))
        used = taken.join(wanted.select("kind", "surrogate"), ["kind", "surrogate"]).distinct().withColumn("used", F.lit(True))
        wanted = wanted.join(used, ["kind", "surrogate"], "left").where("used is null").select("kind", "surrogate", F.col("first").alias("part"), F.lit(True).alias("ok"))
        judged = cut(drawn.join(wanted, ["kind", "surrogate", "part"], "left"))
        kept = judged.where("ok").select("kind", "part", "surrogate")
        done = kept if done is None else done.unionByName(kept)
        left = judged.where("ok is null").select("kind", "part", "gender")
        turn += 1
        if left.isEmpty():
            return done


def entity_table(values: DataFrame, key: str, derive=surrogate) -> DataFrame:
    """value, kinds, parts, made (the parts' surrogates), surrogate for each row of ``values``, distinct entities."""
    split = values.select("value", F.posexplode(value_parts(F.col("value"))).alias("i", "p")).select("value", "i", "p.*")
    # Of a given name, the gender that all its titles agree on.
    sexes = F.collect_set(F.when(F.col("gender") != "n", F.col("gender")))
    parts = cut(split.groupBy("kind", "part").agg(F.when(F.size(sexes) == 1, sexes[0]).otherwise("n").alias("gender")))
    made = split.join(surrogate_table(parts, key, derive), ["kind", "part"])
    made = made.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "part", "surrogate"))).alias("p"))
    return made.select("value", F.col("p.kind").alias("kinds"), F.col("p.part").alias("parts"), F.col("p.surrogate").alias("made"), rendered(F.col("value"), F.col("p.kind"), F.col("p.surrogate")).alias("surrogate"))


#: Between words: where a letter, digit or underscore meets another character.
_WORD = r"(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_])"


def replace_entities(docs: DataFrame, key: str = "tidemark", keep: tuple[str, ...] = ("doc_id",), derive=surrogate) -> DataFrame:
    """The columns of ``keep``, text with surrogates, and n_entities, the places replaced, for each row of ``docs``.

    Texts without entities come through unchanged, null and empty texts as they are with no entities. Rows of equal text share one set of
    replacements, whatever their ids, which may be null or repeated. Texts of any length are replaced whole. Other columns aren't looked at;
    ``keep`` must not name a column text or n_entities. No rows give no rows.
    """
    entities = cut(find_entities(docs))
    table = cut(entity_table(entities.select("value").distinct(), key, derive))
    titled = F.col("kinds")[0].isin("given", "family")
    # Family names come first where a word is both.
    names = F.when(titled, F.reverse(F.arrays_zip(F.col("parts").alias("word"), F.col("made").alias("other"))))
    table = table.select("value", "surrogate", F.coalesce(names, F.array().cast("array<struct<word:string,other:string>>")).alias("names"))
    made = entities.join(table, "value").groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("place", "surrogate"))).alias("made"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    # Plain arrays, so that looking one element up doesn't go through all.
    made = made.select("_k1", "_k2", F.col("made.surrogate").alias("_made"), F.col("names.word").alias("_words"), F.col("names.other").alias("_others"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), "text")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    plain = base.where(~hinted).select("_kept.*", "text", F.lit(0).alias("n_entities"))
    changed = base.where(hinted).select("*", *_text_keys()).join(made, ["_k1", "_k2"], "left")
    split = changed.select("_kept", "text", "_made", "_words", "_others", F.split("text", ENTITY, -1).alias("_between"))

    def replaced(between: Column) -> Column:
        return F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get("_made", i), F.lit("")))), "")

    def by_words(words: Column) -> Column:
        other = lambda w: F.coalesce(F.get("_others", F.array_position("_words", w).cast("int") - 1), w)
        text = replaced(F.transform(words, lambda p: F.array_join(F.transform(p, other), "")))
        count = F.size("_made") + F.size(F.filter(F.flatten(words), lambda w: F.array_contains("_words", w)))
        return F.struct(text.alias("text"), count.alias("n_entities"))

    whole = F.when(F.col("_made").isNull(), F.struct(F.col("text").alias("text"), F.lit(0).alias("n_entities")))
    whole = whole.when(F.size("_words") > 0, let(F.transform("_between", lambda p: F.split(p, _WORD, -1)), by_words))
    whole = whole.otherwise(F.struct(replaced(F.col("_between")).alias("text"), F.size("_made").alias("n_entities")))
    return plain.unionByName(split.select("_kept", whole.alias("_new")).select("_kept.*", "_new.text", "_new.n_entities"))
