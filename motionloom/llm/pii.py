"""Operator 8: personal data replaced by surrogates.

E-mail and IP addresses, phone, card and bank account numbers, and names after a form of
address, a title or words that introduce a name are found by pattern, and the parts of
such a name wherever else they stand in the document. Each distinct value gets one surrogate, drawn from a keyed
hash: digits for digits and letters for letters in the same script, names that fit the
form of address's gender and the name's script, card and account numbers with the check
digits that theirs have. A surrogate that two values would share,
or that is itself a value of the corpus, is drawn again, so distinct values stay
distinct and a value has the same surrogate wherever it stands, in whatever format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, text_key, written

# Forms of address by gender.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
# Titles of either gender, and words that introduce a name.
NEUTRAL = ["Dr", "Prof", "Doctor", "Professor", "Доктор", "Профессор"]
INTRODUCED = ["my name is", "My name is", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут"]
_SYLLABLES = {
    "latin": "ba de fi lo mu na pe ri so tu ka le mi no ru va",
    "cyrillic": "ба де фи ло му на пе ри со ту ка ле ми но ру ва",
    "greek": "βα δε φι λο μυ να πε ρι σο τυ κα λε μι νο ρυ ζα", "arabic": "با دي فا لو مو نا بي ري سو تو كا لي مي نو رو زا",
    "hebrew": "בא די פי לו מו נה פה רי סו תו קה לה מי נו רו זה", "han": "安 宝 成 德 方 国 海 建 君 林 明 宁 平 文 永 志",
    "hiragana": "あ き す て な ふ み ゆ ら を か し つ と に ほ", "katakana": "ア キ ス テ ナ フ ミ ユ ラ ヲ カ シ ツ ト ニ ホ",
    "hangul": "가 나 다 라 마 바 사 아 자 차 카 타 파 하 도 미", "devanagari": "का ना मा रा ला वि शि दे पे सो तो कु मु रु जा हा",
}
ENDINGS = {
    "cyrillic": ("на", "н"), "greek": ("να", "ς"), "arabic": ("ة", "ن"), "hebrew": ("ית", "ן"), "han": ("娜", "强"),
    "hiragana": ("こ", "お"), "katakana": ("コ", "オ"), "hangul": ("희", "수"), "devanagari": ("नी", "न"),
}

LETTERS = {
    "greek": "αβγδεζηικλμνοπρσ", "arabic": "ابتدرسصطعفقكلمنه", "hebrew": "אבגדהוזחטיכלמנסע", "han": "安宝成德方国海建君林明宁平文永志",
    "hiragana": "あきすてなふみゆらをかしつとにほ", "katakana": "アキステナフミユラヲカシツトニホ", "hangul": "가나다라마바사아자차카타파하도미", "devanagari": "कनमरलवशदपसतजहगबय",
}

# A name's part: a capitalised word or one of a script without capitals, an initial; small words may stand between parts.
_PART = "(?:\\p{Lu}['’])?[\\p{Lu}\\p{Lo}][\\p{L}\\p{M}]*(?:['’-][\\p{Lu}\\p{Lo}][\\p{L}\\p{M}]*)*"
_FORMS = "(?:(?:" + "|".join(INTRODUCED) + ") )?(?:(?:" + "|".join(MALE + FEMALE + NEUTRAL) + ")\\.? )+|(?:" + "|".join(INTRODUCED) + ") "
_FORMS = f"(?:{_FORMS})"

# Patterns by kind; a form of address needs a capitalised name, all else ignores case.
PATTERNS = {
    "email": "[\\p{L}\\p{N}_%+-]+(?:\\.[\\p{L}\\p{N}_%+-]+)*@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+",
    "iban": "\\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\\b",
    "phone": "(?<![\\p{L}\\p{N}])\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    "|(?<![\\p{L}\\p{N}.+-])(?:\\([0-9]{2,5}\\) ?[0-9]{3,4}[ .-]?[0-9]{3,5}|0[0-9]{1,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,5}){0,3}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[0-9]{3} [0-9]{3} [0-9]{4})(?![0-9])",
    "card": "(?<![0-9.])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -]?[0-9]{3})?|3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}|4[0-9]{12}|[456][0-9]{16,17})(?![0-9])",
    "ip": "(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\\.[0-9])",
    "ip6": "(?<![\\p{L}\\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}))(?![\\p{L}\\p{N}:])",
    "name": f"(?<!\\p{{L}}){_FORMS}{_PART}\\.?(?:(?<=\\p{{L}}| \\p{{Lu}}\\.) (?:(?:van|von|der|den|de|da|di|la|le|bin|al) ){{0,2}}{_PART}){{0,3}}(?<!\\.)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must hold for the patterns to be tried at all.
HINT = "[0-9@]|::|" + "|".join(MALE + FEMALE + NEUTRAL + INTRODUCED)
DIGITS = ["phone", "card", "iban"]


def _kind(value: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _bare(kind: Column, value: Column) -> Column:
    """The value without its format: digits of numbers, a name's part in lower case."""
    return F.when(kind.isin(DIGITS), F.upper(F.regexp_replace(value, "[^\\p{L}\\p{N}]", ""))).otherwise(F.lower(value))


def _gender(name: Column) -> Column:
    """f or m by the forms of address before a name, empty for a title or an introduction alone."""
    before = F.regexp_extract(name, "^" + _FORMS, 0)
    said = lambda forms: before.rlike("(?<!\\p{L})(?:" + "|".join(forms) + ")(?!\\p{L})")
    return F.when(said(FEMALE), "f").when(said(MALE), "m").otherwise("")


def _luhn(digits: Column) -> Column:
    """The check digit that makes a number (which ends in any one) pass the Luhn sum."""
    places = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i == 0, 0).otherwise(F.when(i % 2 == 1, F.get(F.array(*[F.lit(d) for d in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))))
    return F.pmod(-F.aggregate(places, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    """A number written in digits and letters (A is 10), modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _checked(kind: Column, bare: Column, number: Column) -> Column:
    """number with valid check digits if bare has them: the last one of a card, the third and fourth place of an account."""
    card = F.concat(F.substring(number, F.lit(1), F.length(number) - 1), _luhn(number))
    is_card = (kind == "card") & bare.rlike("^[0-9]+$")
    valid_card = F.when(is_card, F.substring(bare, -1, 1) == _luhn(bare)).otherwise(False)
    country = F.substring(bare, 1, 2)
    moved = lambda x, digits: F.concat(F.substring(x, F.lit(5), F.length(x)), country, digits)
    is_account = (kind == "iban") & bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$")
    valid_account = F.when(is_account, _mod97(moved(bare, F.substring(bare, 3, 2))) == 1).otherwise(False)
    plain = F.upper(number)
    account = F.concat(country, F.lpad((98 - _mod97(moved(plain, F.lit("00")))).cast("string"), 2, "0"), F.substring(plain, F.lit(5), F.length(plain)))
    return F.when(valid_card, card).when(valid_account, account).otherwise(number)


def _filled(bare: Column, stream: Column) -> Column:
    """bare with each letter and digit replaced from the hash, script kept."""
    at = lambda i, alphabet: F.translate(F.substring(stream, (i % 120 + 1).cast("int"), F.lit(1)), "0123456789abcdef", alphabet)
    one = lambda c, i: (
        F.when(c.rlike("[0-9]"), at(i, "0123456789135792"))
        .when(c.rlike("[\\p{IsCyrillic}]"), at(i, "абвгдежзиклмнопр"))
        .when(c.rlike("[A-Z]"), at(i, "ABCDEFGHKLMNPRST"))
        .when(c.rlike("[a-z]"), at(i, "abcdefghklmnprst"))
        .otherwise(elsewhere(c, i))
    )

    def elsewhere(c: Column, i: Column) -> Column:
        letter = F.when(c.rlike("\\p{L}"), at(i, "abcdefghklmnprst")).otherwise(c)
        for script, alphabet in LETTERS.items():
            letter = F.when(c.rlike(f"\\p{{Is{script.capitalize()}}}"), at(i, alphabet)).otherwise(letter)
        return letter

    return F.array_join(F.transform(F.split(bare, ""), one), "")


def _name(bare: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A name of four syllables, one more for each later attempt, and a gendered ending, in the script of bare."""

    def of(script: str, endings: tuple[str, str]) -> Column:
        table = F.array(*[F.lit(s) for s in _SYLLABLES[script].split()])
        syllable = lambda k: F.element_at(table, (F.conv(F.substring(stream, k, F.lit(1)), 16, 10).cast("int") + 1))
        syllables = F.transform(F.sequence(F.lit(1), F.least(attempt + 4, F.lit(120))), syllable)
        return F.concat(F.array_join(syllables, ""), F.when(gender == "f", endings[0]).when(gender == "m", endings[1]).otherwise(""))

    name = of("latin", ("na", "n"))
    for script, endings in ENDINGS.items():
        name = F.when(bare.rlike(f"\\p{{Is{script.capitalize()}}}"), of(script, endings)).otherwise(name)
    return name


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, gender, bare, attempt) with the surrogate of that attempt."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "gender", "bare", F.col("attempt").cast("string")), 512)
    octet = lambda k: (F.pmod(F.conv(F.substring(stream, 3 * k, 3), 16, 10).cast("int"), F.lit(254)) + 1).cast("string")
    ip = F.concat_ws(".", *[octet(k) for k in range(1, 5)])
    domain = F.regexp_extract("bare", "(\\.[^.]*)$", 1)  # an address keeps its top-level domain
    email = F.concat(_filled(F.regexp_replace("bare", "\\.[^.]*$", ""), stream), domain)
    # A number keeps its first place; if most numbers of its length are taken, later draws have more digits.
    more = F.substring(F.translate(F.substring(stream, 61, 60), "abcdef", "123456"), F.lit(1), F.greatest(F.lit(0), F.col("attempt") - 8))
    drawn = F.concat(F.substring("bare", 1, 1), _filled(F.substring("bare", F.lit(2), F.length("bare")), stream), F.when(F.col("kind") == "card", "").otherwise(more))
    number = _checked(F.col("kind"), F.col("bare"), drawn)
    # Likewise an address of four numbers, of which there are few, is one of eight after many draws.
    ip6 = F.concat_ws(":", *[F.substring(stream, 4 * k + 61, 4) for k in range(8)])
    surrogate = F.when((F.col("kind") == "ip") & (F.col("attempt") <= 12), ip).when(F.col("kind") == "ip", ip6).when(F.col("kind") == "ip6", ip6).when(F.col("kind") == "email", email).when(F.col("kind") == "name", _name(F.col("bare"), F.col("gender"), stream, F.col("attempt"))).otherwise(number)
    return entities.withColumn("surrogate", surrogate)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, gender, bare, surrogate) for distinct entities (kind, gender, bare), one to one within a kind.

    Of values that draw the same surrogate the least keeps it; the others, and those that
    draw a value of the corpus, draw again, as often as need be: what can be drawn grows
    with the attempts.
    """
    values = entities.select("kind", F.col("bare").alias("surrogate")).distinct()
    settled, pending = None, _drawn(entities.withColumn("attempt", F.lit(0)), key)
    while True:
        drawn = written(pending, "drawn")
        owner = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("gender", "bare")).alias("owner"))
        free = owner.join(values, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        mine = free.select("kind", "surrogate", F.col("owner.gender").alias("gender"), F.col("owner.bare").alias("bare"))
        good = drawn.join(mine, ["kind", "gender", "bare", "surrogate"], "left_semi").select("kind", "gender", "bare", "surrogate")
        settled = written(good if settled is None else settled.union(good), "settled")
        again = drawn.join(settled, ["kind", "gender", "bare"], "left_anti").withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        again = written(again, "again")
        if again.isEmpty():
            return settled
        pending = _drawn(again, key)


def _shown(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the value it replaces."""
    chars = F.split(value, "")
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^\\p{L}\\p{N}]", ""))
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[\\p{L}\\p{N}]"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c)), "")
    own = F.length(F.regexp_replace(value, "[^\\p{L}\\p{N}]", ""))
    number = F.concat(number, F.substring(surrogate, own + 1, F.length(surrogate)))
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("\\p{Lu}"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    name = F.when(value.rlike("^\\p{Lu}{2,}$"), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin(DIGITS), number).when(kind == "email", cased).when(kind == "name", name).otherwise(surrogate)


def _found(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, place, kind, gender, part, value, bare) of docs' entities, names part by part."""
    hinted = docs.filter(F.col("text").rlike(HINT))
    values = hinted.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("place", "value"))
    values = values.withColumn("kind", _kind(F.col("value"))).filter("kind is not null")
    gender = F.when(F.col("kind") != "name", "").otherwise(_gender(F.col("value")))
    pieces = F.when(F.col("kind") == "name", _parts(F.col("value"))).otherwise(F.array("value"))
    each = values.withColumn("gender", gender).select("doc_id", "tk", "place", "kind", "gender", F.posexplode(pieces).alias("part", "value"))
    each = each.withColumn("bare", _bare(F.col("kind"), F.col("value")))
    known = F.max("gender").over(Window.partitionBy("doc_id", "tk", "kind", "bare"))  # a title alone takes the gender that a form of address says elsewhere
    return each.withColumn("gender", F.when(F.col("gender") == "", known).otherwise(F.col("gender")))


def _parts(name: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(name, "^" + _FORMS, ""), F.lit(_PART), F.lit(0))


def _rewritten(value: Column, place: Column) -> Column:
    """value with what _shown has for its place, for a name part by part."""
    at = lambda j: F.try_element_at("_shown", F.struct(place.alias("place"), j.alias("part")))
    rest = F.regexp_replace(value, "^" + _FORMS, "")
    named = F.transform(F.split(rest, _PART), lambda gap, j: F.concat(gap, F.coalesce(at(j), F.get(_parts(value), j), F.lit(""))))
    return F.when(value.rlike("^" + _FORMS), F.concat(F.regexp_extract(value, "^" + _FORMS, 0), F.array_join(named, ""))).otherwise(F.coalesce(at(F.lit(0)), value))


def _mentions(text: Column) -> Column:
    """text with the surrogates of the document's names, which stand in _names, where a name's part stands alone."""
    edge = "(?![\\p{L}\\p{N}])"
    swap = lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?<![\\p{L}\\p{N}])\\Q"), n["value"], F.lit("\\E" + edge)), n["shown"])
    return F.when(F.size("_names") > 0, F.aggregate("_names", text, swap)).otherwise(text)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with all its columns, its text with surrogates for personal data, and n_entities.

    A text without personal data stays as it is. A null text stays null, an empty one
    empty, both with no entities. Rows that repeat a doc_id are told apart by their text;
    rows alike in both get the same result; a null doc_id is allowed. A very long text is
    rewritten whole, in one task. An empty table
    gives an empty result. A column named n_entities is replaced.
    """
    rows, names, doc_id, text = numbered(docs, ("n_entities",))
    found = written(_found(rows.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).distinct(), "entities")
    mapped = surrogates(found.select("kind", "gender", "bare").distinct(), key)
    shown = found.join(mapped, ["kind", "gender", "bare"])
    shown = shown.select("doc_id", "tk", "place", "part", "kind", "gender", "value", _shown(F.col("value"), F.col("kind"), F.col("surrogate")).alias("shown"))
    places = F.map_from_entries(F.collect_list(F.struct(F.struct("place", "part"), "shown")))
    alone = (F.col("kind") == "name") & (F.length("value") > 1)
    names_of = F.sort_array(F.collect_set(F.when(alone, F.struct((-F.length("value")).alias("size"), "value", "gender", "shown"))))
    per_doc = shown.groupBy("doc_id", "tk").agg(places.alias("_shown"), names_of.alias("_names"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "_shown", "_names")

    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_tk"))
    touched = rows.filter(hinted).withColumn("_key", text_key(F.col(text))).join(per_doc, same, "left")
    touched = touched.withColumns({"_parts": F.split(text, ANY), "_values": F.regexp_extract_all(text, F.lit(ANY), F.lit(0))})
    pieces = F.transform(F.col("_parts"), lambda p, i: F.concat(_mentions(p), F.coalesce(_rewritten(F.get("_values", i), i), F.lit(""))))
    new = F.when(F.col("_shown").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    columns = lambda t: [t if f"c{i}" == text else F.col(f"c{i}") for i in range(len(names))]
    changed = touched.select(*columns(new), F.when(F.col("_shown").isNull(), 0).otherwise(F.size(F.array_distinct(F.transform(F.map_keys("_shown"), lambda k: k["place"])))).cast("long"))
    rest = rows.filter(~hinted).select(*columns(F.col(text)), F.lit(0).cast("long"))
    return changed.toDF(*names, "n_entities").union(rest.toDF(*names, "n_entities"))
