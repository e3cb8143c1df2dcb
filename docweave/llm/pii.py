"""Surrogates for personal data.

Entities (mail addresses, phone, card, account and social security numbers, IP
addresses, secrets, names of persons) are replaced in place by keyed surrogates
of the same kind and form. A surrogate depends on the key and on the entity's
canonical form alone, so all mentions of one entity get the same surrogate in
every document, and in whichever spelling. Over the distinct entities of all
documents two checks keep distinct entities apart: no two share a surrogate,
and no surrogate is itself an entity that occurs. Losers are drawn again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, forgotten, let, partitions, stored, text_of, unused

# Titles, and given names by script and gender; of these one is drawn, and by these a name is known.
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sir", "f": "Mrs Ms Miss Frau Madame Mme Señora Lady", "n": "Dr Prof Professor Doctor"}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Paul Mark Peter Hans Karl Jürgen Stefan Pierre Jean Luc Antoine Carlos Juan Miguel José Pablo",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Nancy Lisa Anna Ursula Petra Sabine Heidi Marie Claire Sophie Isabelle Camille María Carmen Lucía Elena",
    ("latin", "n"): "Alex Robin Kim Chris Sam Jamie Taylor Jordan Casey Morgan Dominique Andrea",
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана",
    ("cyrillic", "n"): "Саша Женя Валя",
    ("greek", "m"): "Γιώργος Νίκος Κώστας Αλέξης Παύλος Πέτρος Σπύρος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα Ειρήνη",
    ("greek", "n"): "Άρτεμις Παναγιώτα Χρύσανθος",
    ("han", "m"): "伟 强 军 勇 杰 涛 建国 志强",
    ("han", "f"): "芳 娜 静 丽 敏 燕 秀英 美玲",
    ("han", "n"): "文 华 平 宁 欣 晨 子安 雨辰",
}
#: Scripts whose given names begin with a capital, so that a given name and a word after it are a name.
CASED = ("latin", "cyrillic", "greek")
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve wa we za zo", "cyrillic": "ба бе бо ва ве го да до жа за зо ка ко ла ле ло ма ме мо на не но па по ра ро са со та то",
             "greek": "βα βε βι γα γο δα δε κα κι κο λα λε λο μα με μι να νε νο πα πε ρα ρι σα σο τα το"}
SURNAMES = "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 马 朱 胡 郭 何 林 高 罗"
#: Letters that stand for a letter of their script; a letter of another script turns into a Latin one.
LETTERS = {"Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρτυφχψω", "Han": "安白北昌城春德东方风光国海河花江金兰里林明南平青山石水田文西新阳云中", "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねの",
           "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノ", "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초", "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת", "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"}



def one_of(words: str) -> str:
    """A pattern for any of some words, told apart by their first letters first."""
    by: dict[str, list[str]] = {}
    for w in sorted(words.split(), key=lambda w: (w[0], -len(w))):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


SECRETS = r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key)\s{0,3}[=:]"
NAME = r"\p{Lu}[\p{L}'’-]+"
#: A name in a script without capitals, which only a title tells.
BARE = r"\p{Lo}[\p{Lo}\p{M}·]+"
TITLE = one_of(" ".join(TITLES.values()))
LEXICON = one_of(" ".join(names for (script, g), names in GIVEN.items() if g != "n" and script in CASED))
#: Eight groups, or fewer around one ::, which may also stand first; one of the shortened has a digit, so that C++'s a::b is none.
GROUP = "[0-9A-Fa-f]{1,4}"
SHORT = "|".join(f"(?:{GROUP}:){{{n}}}(?::{GROUP}){{1,{7 - n}}}" for n in range(1, 7)) + f"|(?:{GROUP}:){{1,7}}:|::{GROUP}(?::{GROUP}){{0,6}}"
IPV6 = rf"(?=[0-9A-Fa-f:])(?<![0-9A-Fa-f:])(?:(?:{GROUP}:){{7}}{GROUP}(?![0-9A-Fa-f:])|(?=[A-Fa-f:]*\d)(?:{SHORT})(?![\p{{L}}\p{{N}}:]|\.\d))"
#: Every pattern starts where a word or number starts, or with a sign; ANY looks for that once.
PATTERNS = {
    "secret": rf"(?=[tspaTSPA]){SECRETS}\s{{0,3}}[\"']?(?=[+/_=~.-]*[A-Za-z0-9])[A-Za-z0-9+/_=~.-]{{8,}}",
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ipv6": IPV6,
    "ipv4": r"(?=\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)(?!\d|\.\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])(?<=\d[A-Z ]{0,9})",
    "phone": r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?=[(\d])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?!\d)",
    "ssn": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<![.-])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d])|(?=\d)(?<![.-])\d{4}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "person": rf"(?=\p{{Lu}})(?:{TITLE}\.? (?:{NAME}(?: {NAME})?|{BARE}(?: {BARE})?)|{LEXICON} {NAME})",
}
ANY = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What every entity has: a digit or an @, the name of a secret, the start of a key, or a title or given name. Cheap to look for.
HINT = rf"[0-9@]|(?=[tspaTSPA]){SECRETS}|AKIA|gh[pousr]_|sk-|(?:[A-Fa-f]{{1,4}}:){{7}}|[a-f]{{32}}|[A-F]{{32}}|(?<!\p{{L}})(?=\p{{Lu}})(?:{TITLE}|{LEXICON})(?!\p{{L}})"


#: Tries in one form; random surrogates of a form that is not nearly full collide this often by no chance.
ROUNDS = 8


def kind_of(m: Column) -> Column:
    out = F.when(m.rlike(rf"^(?:{PATTERNS['secret']})$"), "secret").when(m.contains("@"), "email")
    for kind in ("ipv6", "ipv4", "iban", "phone", "ssn", "card", "key"):
        out = out.when(m.rlike(rf"^(?:{PATTERNS[kind]})$"), kind)
    return out.otherwise("person")


def value_of(m: Column, kind: Column) -> Column:
    """The part of a match that is replaced: a secret's value, a name without its title, a phone number without its country code."""
    return (F.when(kind == "secret", F.regexp_extract(m, r"[=:]\s*[\"']?([^\"']*)$", 1))
            .when(kind == "person", F.regexp_replace(m, rf"^{TITLE}\.? ", ""))
            .when((kind == "phone") & m.startswith("+"), F.regexp_extract(m, r"^\+\d{1,3}?(?:[ .(-]+|(?=\d))(.*)$", 1)).otherwise(m))


def canon_of(value: Column, kind: Column) -> Column:
    """One form for all spellings of an entity."""
    return F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.regexp_replace(F.lower(value), " ", "")).otherwise(F.lower(value))


def byte(stream: Column, i: Column) -> Column:
    """Byte i of a hex stream, which starts again when it ends."""
    return F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letter_like(c: Column, at: Column) -> Column:
    """Letter number ``at`` of the script that letter ``c`` is of, as a small letter."""
    letters = F.lit(LETTERS["Latin"])
    for script, others in LETTERS.items():
        if script != "Latin":
            letters = F.when(c.rlike(rf"\p{{Is{script}}}"), others).otherwise(letters)
    return let(letters, lambda letters: F.substring(letters, at % F.length(letters) + 1, F.lit(1)))


def same_form(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """Digits for digits, letters for letters of the same script and case; marks stay. Place counts letters and digits only, so spellings agree."""
    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        b = byte(stream, at) + F.floor(at / 32).cast("int") * 7
        ascii_letter = F.chr(F.lit(97) + b % F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26)))
        letter = F.when(c <= "z", ascii_letter).otherwise(letter_like(c, b))
        return F.when(c.rlike(r"^\p{N}$"), (b % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(letter)).when(c.rlike(r"^\p{L}$"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def luhn(digits: Column) -> Column:
    """The checksum of a number's digits; a valid number has 0."""
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((F.length(digits) - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10


def titled(m: Column) -> Column:
    """What a mention's title says of gender: 2 and 1, or 0 for nothing."""
    by = lambda g: m.rlike(rf"^(?:{'|'.join(TITLES[g].split())})\.? ")
    return F.when(by("m"), 2).when(by("f"), 1).otherwise(0)


def name_of(value: Column, m: Column, stream: Column, tries: Column) -> Column:
    """Another given name of the same gender and script, and a family name made up; in a script of which no names are listed, other letters."""
    first = F.initcap(F.regexp_extract(value, r"^\S+", 0))  # in any spelling
    gender = F.lit("n")
    for g in ("m", "f"):
        names = [n for (_, x), ns in GIVEN.items() if x == g for n in ns.split()]
        gender = F.when(first.isin(names), g).otherwise(gender)
    gender = let(titled(m), lambda t: F.when(t == 2, "m").when(t == 1, "f").otherwise(gender))
    return let(first, lambda first: let(gender, lambda gender: let(named(value, first, gender, stream, tries), lambda out: F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(out)).otherwise(out))))


def named(value: Column, first: Column, gender: Column, stream: Column, tries: Column) -> Column:
    """``name_of``, in small letters but for the first of each name."""
    words = lambda text: F.array(*[F.lit(w) for w in text.split()])
    pick = lambda items, i: let(items, lambda items: F.element_at(items, F.pmod(byte(stream, F.lit(i)) * 256 + byte(stream, F.lit(i + 1)), F.size(items)) + 1))
    listed_for = lambda script: reduce(lambda c, g: c.when(gender == g, words(GIVEN[script, g])), ("m", "f"), F.when(gender == "n", words(GIVEN[script, "n"])))
    several = F.sequence(F.lit(1), F.lit(4) + tries)
    # marks, digits and letters of scripts without names of their own; longer at each try
    out = same_form(F.concat(value, F.repeat(F.substring(value, F.lit(-1), F.lit(1)), tries)), stream, F.lit(False))
    han = F.concat(pick(words(SURNAMES), 0), pick(listed_for("han"), 2), F.array_join(F.transform(F.slice(several, 1, tries), lambda i: F.element_at(words(GIVEN["han", "n"]), byte(stream, i + 4) % len(GIVEN["han", "n"].split()) + 1)), ""))
    out = F.when(value.rlike(r"^\p{IsHan}+$"), han).otherwise(out)
    for script, listed in SYLLABLES.items():
        given = pick(F.array_remove(listed_for(script), first), 0)  # never the same name
        family = family_of(stream, several, listed)
        # as many names as before: one after a title is a family name
        name = F.when(value.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)
        out = F.when(value.rlike(rf"\p{{Is{script.capitalize()}}}"), name).otherwise(out)
    return out


def family_of(stream: Column, places: Column, syllables: str) -> Column:
    """A family name of as many syllables as ``places``."""
    listed = F.array(*[F.lit(w) for w in syllables.split()])
    return F.initcap(F.array_join(F.transform(places, lambda i: F.element_at(listed, byte(stream, i + 2) % F.size(listed) + 1)), ""))


def surrogate(m: Column, kind: Column, value: Column, tries: Column, key: str) -> Column:
    """The surrogate of one value; ``tries`` counts how often it was drawn again."""
    def drawn(stream: Column) -> Column:
        octet = lambda i: (byte(stream, F.lit(i)) % 254 + 1).cast("string")
        form = F.when(kind.isin("ipv4", "person"), "").otherwise(longer(value, kind, tries))
        return let(same_form(form, stream, value.rlike("^[0-9a-fA-F:]+$")), lambda plain: finished(plain, stream, octet))

    def finished(plain: Column, stream: Column, octet) -> Column:
        # the last part of a mail address's domain stays, so that it is one
        mail = F.concat(F.regexp_replace(plain, r"\.[^.]*$", ""), F.regexp_extract(value, r"\.[^.]*$", 0))
        return (F.when(kind == "ipv4", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))).when(kind == "email", mail)
                .when(kind == "card", F.when(luhn(F.regexp_replace(value, r"\D", "")) == 0, checked(plain)).otherwise(plain))
                .when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(plain, 3, 1000)))
                .when(kind == "person", name_of(value, m, stream, tries)).otherwise(plain))

    return let(F.sha2(F.concat_ws("\x00", F.lit(key), kind, canon_of(value, kind), tries.cast("string")), 256), drawn)


def longer(value: Column, kind: Column, tries: Column) -> Column:
    """The form to draw from: the value's own, and a longer one each ROUNDS tries, so that there is always one left."""
    more = F.repeat(F.lit("0"), F.floor(tries / ROUNDS).cast("int"))
    return (F.when(tries < ROUNDS, value).when(kind == "ipv6", F.concat(F.lit("0" + ":0000" * 7), more))
            .when(kind == "email", F.concat(F.lit("a"), more, value)).otherwise(F.concat(value, more)))


def checked(number: Column) -> Column:
    """``number`` with a last digit that makes it valid."""
    head = F.substring(number, F.lit(1), F.length(number) - 1)
    return F.concat(head, ((10 - luhn(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0")))) % 10).cast("string"))


def matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, tries) of the entities that had to be drawn again; entities: kind, canon, m, value, one row each."""
    now = entities.withColumn("tries", F.lit(0))
    known, last = entities.select("kind", F.col("canon").alias("new")), None
    n = partitions(entities.sparkSession)
    while True:
        # drawing is the work here: spread it, however small the table
        drawn = now.repartition(n, "kind", "canon").withColumn("new", canon_of(surrogate(F.col("m"), F.col("kind"), F.col("value"), F.col("tries"), key), F.col("kind")))
        # the first of those that drew the same keeps it
        drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("kind", "new").orderBy("tries", "canon")))
        drawn = drawn.join(known.withColumn("real", F.lit(True)), ["kind", "new"], "left")
        now = stored(drawn.select("kind", "canon", "m", "value", (F.col("tries") + F.when((F.col("nth") > 1) | F.col("real"), 1).otherwise(0)).alias("next"), "tries"), "surrogates")
        if last is not None:
            forgotten(last)
        last, lost = now, now.where("next > tries").limit(1).count()
        now = now.select("kind", "canon", "m", "value", F.col("next").alias("tries"))
        if not lost:
            return now.where("tries > 0").select("kind", "canon", "tries")


def surrogates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced and ``n_entities`` added.

    Null text stays null, and a text without entities, or empty, stays as it is;
    texts of any length are read whole. Ids are not used, so rows without one and
    rows that repeat one are like others; equal texts are replaced alike. Of entities that
    draw the same surrogate (a tie) the first by tries and canonical form keeps it. An empty table
    gives an empty table; a column named n_entities is replaced, all other
    columns stay, whatever their names.
    """
    body, found, new, drawn, at = unused(docs, "_body", "_found", "_new", "_drawn", "_at")
    df = docs.withColumn(body, text_of(text))
    entity = lambda m, k, v: F.struct(m.alias("m"), k.alias("kind"), v.alias("value"), canon_of(v, k).alias("canon"))
    df = df.withColumn(found, F.transform(matches(F.col(body)), lambda m: let(kind_of(m), lambda k: let(value_of(m, k), lambda v: entity(m, k, v)))))
    mentions = df.select(F.explode(found).alias("e")).select("e.*").withColumn("title", titled(F.col("m")))
    # one mention, of the most telling title, stands for all: it settles the gender
    telling = F.struct("title", "m")
    entities = mentions.groupBy("kind", "canon").agg(F.max_by("m", telling).alias("m"), F.max_by("value", telling).alias("value"), (F.min("title") < F.max("title")).alias("varied"))
    entities = stored(entities.repartition(partitions(docs.sparkSession), "kind", "canon"), "entities")
    again = collisions(entities.drop("varied"), key)
    again = entities.join(again, ["kind", "canon"], "left").where(F.col("varied") | F.col("tries").isNotNull()).select("kind", "canon", F.struct(F.coalesce("tries", F.lit(0)).alias("tries"), F.col("m")).alias("drawn"))
    if again.limit(1).count():
        # texts that mention an entity drawn again, or with other titles elsewhere, take its tries and that mention along
        name = F.concat(F.hex(F.xxhash64(F.lit("a"), body)), F.hex(F.xxhash64(F.lit("b"), body)))
        few = df.where(F.size(found) > 0).select(name.alias(f"_{at}"), F.explode(found).alias("e")).join(again, (F.col("e.kind") == F.col("kind")) & (F.col("e.canon") == F.col("canon")))
        few = few.groupBy(f"_{at}").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x00", F.col("e.kind"), F.col("e.canon")).alias("k"), F.col("drawn")))).alias(drawn))
        df = df.withColumn(at, name).join(few, F.col(at) == F.col(f"_{at}"), "left").drop(at, f"_{at}")
    else:
        df = df.withColumn(drawn, F.lit(None).cast("map<string,struct<tries:int,m:string>>"))

    def replaced(e: Column) -> Column:
        again = F.col(drawn)[F.concat_ws("\x00", e["kind"], e["canon"])]
        made = surrogate(F.coalesce(again["m"], e["m"]), e["kind"], e["value"], F.coalesce(again["tries"], F.lit(0)), key)
        return F.concat(F.substring(e["m"], F.lit(1), F.length(e["m"]) - F.length(e["value"])), made)

    df = df.withColumn(new, F.transform(found, replaced))
    between = F.split(F.col(body), ANY, -1)
    out = F.array_join(F.zip_with(between, F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    df = df.withColumn("n_entities", F.size(found).cast("long")).withColumn(text, F.when(F.size(found) > 0, out).otherwise(column(text)))
    return df.drop(body, found, new, drawn)
