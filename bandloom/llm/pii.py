"""Surrogates for personal data, in DataFrame operations only.

Detected entities (e-mail addresses, phone, card, social security and bank account numbers, IP addresses, and names
after an honorific) are replaced by keyed surrogates: SHA-256 of a secret key and the normalised entity decides, so an
entity has one surrogate wherever and however it is written. Surrogates keep the type (a card number that passes its
checksum gets one that passes, addresses stay in range), the format (separators, length, capitals), and for names gender
and script (where the title doesn't tell the gender, the given name does by a list or its ending, and else a neutral name
comes); a name's parts are replaced part by part, so "Mr. Adam Bell" and "Mr. Bell" still agree, and all bare mentions of
its given names and surnames in the document follow, as they were written after the honorific, in capitals, or with capital
initials. Phone numbers without an area code are detected after a word that announces them.

Distinctness is checked over the corpus: entities whose surrogates meet, or meet a real entity, are drawn again with a
higher attempt until none is left; names and addresses grow longer then. Only these few exceptions are joined to the
documents that hold them; all others are replaced where they stand. Texts are never shuffled for that, unless there are
exceptions too many to send along.

Defined results: null texts stay null; empty texts and texts without entities stay as they are; texts are read whole,
whatever their length; of patterns that fit at one place the first in PATTERN goes; of entities that drew one surrogate the
least (by attempt, kind, value) keeps it; ValueError where a kind has no room left for distinct surrogates; repeated rows
give repeated results; an empty table gives an empty result; extra columns, whatever their names, pass by, and give way
where they are named as a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, set_aside, text_or_empty, written

#: Draws before a kind counts as full: with half of the room taken, one entity in 10^7 is left.
ROUNDS = 24
#: The session's setting that holds the secret key, and the key of a session without one: for tests, not for real data.
KEY_SETTING, DEMO_KEY = "spark.bandloom.pii.key", "public key for demonstrations"
#: Digits of a phone number without its country code, which stays.
NATIONAL = 10
#: Honorifics by the gender they tell.
MALE = ("Mr", "Mister", "Sir", "Herr", "Señor", "Monsieur", "Signor", "Господин", "господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Madame", "Mme", "Signora", "Госпожа", "госпожа", "Κυρία", "κυρία")
EITHER = ("Dr", "Prof", "Doctor", "Professor", "Доктор", "доктор")
# Common given names by gender, for titles that don't tell it; those of the surrogates count, too.
KNOWN_MALE = "james john robert michael william david richard joseph thomas charles christopher matthew mark donald steven andrew kenneth joshua kevin brian george edward jason jeffrey ryan jonathan nicholas eric stephen larry scott benjamin samuel gregory raymond patrick jack dennis jerry adam juan jose carlos luis miguel pedro javier antonio pierre jean michel philippe hans jürgen klaus wolfgang uwe giovanni marco luca".split()
KNOWN_FEMALE = "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca sharon cynthia kathleen amy angela shirley anna anne brenda pamela nicole samantha katherine christine catherine carmen ana isabel lucia elena marie françoise monique sophie claire ingrid ursula heike sabine giulia chiara francesca".split()
#: Given names of the surrogates, by script and gender (n where nothing tells it); surnames are made of syllables.
GIVEN = {
    ("latin", "m"): "Adrian Alan Albert Andreas Anton Arthur Boris Bruno Carl Conrad Daniel Denis Edgar Emil Erik Felix Frank Gustav Hector Henry Hugo Ivan Jacob Julius Kurt Leon Louis Martin Maurice Nils Oscar Paul Peter Quentin Ralph Rolf Simon Stefan Theodor Victor".split(),
    ("latin", "f"): "Ada Agnes Alma Amelia Berta Camilla Clara Dora Diana Edith Elsa Emma Flora Frida Greta Hanna Helen Ida Irene Johanna Julia Karin Laura Lydia Maria Marta Nadia Nina Nora Olga Paula Petra Rita Rosa Sabina Sonia Teresa Tina Ursula Vera".split(),
    ("latin", "n"): "Alex Ariel Ashton Blair Cameron Casey Charlie Dakota Drew Eden Finley Harper Jamie Jesse Jordan Kai Kendall Lee Logan Morgan Noel Parker Quinn Reese Riley Robin Rowan Sage Skyler Taylor".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура Слава Паша".split(),
    ("greek", "n"): "Ροδή Φανή Αγάπη".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Макар Олег".split(),
    ("cyrillic", "f"): "Алла Белла Вера Галина Дарья Ева Зоя Инна Клара Лидия Марина Ольга".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Κώστας Λουκάς Μάριος Νίκος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba den for gar hol ken lam mer nor pel quin ros sal tor ven wil".split(),
    "cyrillic": "ба ден ка лов мар нор пет рос сал тар вер зим гор бел дым кор".split(),
    "greek": "βα δεν κα λο μαρ νι πετ ρο σαλ τερ φω ζη γορ θα κυρ μα".split(),
}
TITLES = [x for t in (*MALE, *FEMALE, *EITHER) for x in dict.fromkeys((t, t.upper()))]
HONORIFIC = "(?:" + "|".join(sorted(TITLES, key=lambda t: -len(t))) + r")(?:\.|(?!\p{L}))"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![\w:.])(?:(?:{HEX}:){{7}}{HEX}|(?=[A-Fa-f:]*\d)(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\w:])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])|(?<=(?:SSN|[Ss]ocial [Ss]ecurity [Nn]umber)[:# ]{1,3})\d{3} ?\d{2} ?\d{4}(?!\w)"
ABROAD = r"(?<![\w+])(?=\+(?:\d[ .()-]{0,2}){8,15}(?![\d]))\+\d{1,3}(?:[ .-]?(?:\(\d{1,5}\)|\d{1,10})){1,6}(?!\w)"
CARD = r"(?<![\w.])(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?!\w)"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
LOCAL = r"(?<=\b(?:[Tt]el|[Pp]hone|[Cc]all|[Ff]ax|[Mm]obile|TEL|PHONE|FAX)\.?:? {1,2})\d{3}[ .-]\d{4}(?![\w-])"
#: Small words inside surnames; they stay.
PARTICLE = "(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ten|ter|zu|zur|bin|al)"
PART = rf"(?!{HONORIFIC})" + r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}(?:['’]\p{Lu})?\p{L}+)*+"
NAME = rf"(?<![\p{{L}}\p{{N}}]){HONORIFIC}\s{{1,3}}(?:{PARTICLE} ){{0,3}}{PART}(?: {{1,2}}(?:{PARTICLE} ){{0,3}}{PART}){{0,3}}"
PATTERN = "|".join((EMAIL, IBAN, IP6, IP, SSN, ABROAD, CARD, PHONE, LOCAL, NAME))
LIKELY = rf"[0-9@]|(?:[A-Fa-f]{{1,4}}:){{7}}|(?<!\p{{L}}){HONORIFIC}\s"
KINDS = ("email", "iban", "ip", "ssn", "card", "phone", "name")

lit = F.lit


def kind_of(m: Column) -> Column:
    digits = F.length(F.regexp_replace(m, r"\D", ""))
    return (
        F.when(F.contains(m, lit("@")), "email").when(F.contains(m, lit(":")), "ip").when(F.rlike(m, lit(r"^[A-Z]{2}\d{2}")), "iban").when(F.rlike(m, lit(r"^\p{L}")), "name")
        .when(F.rlike(m, lit(r"^\d+(?:\.\d+){3}$")), "ip").when(F.rlike(m, lit(r"^\d{3}[ -]?\d{2}[ -]?\d{4}$")), "ssn")
        .when((digits >= 13) & ~F.rlike(m, lit(r"[+(]")), "card").otherwise("phone")
    )


def plain(kind: Column, m: Column) -> Column:
    """The entity, however it is written."""
    digits = F.regexp_replace(m, r"\D", "")
    return F.when(kind == "phone", F.right(digits, lit(NATIONAL))).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(m, lit(" "), lit(""))).otherwise(F.lower(m))


def bits(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", lit(key), kind, value, attempt.cast("string")), 256)


def digit_stream(hexes: Column) -> Column:
    return F.translate(hexes, "abcdef", "135790")


def luhn(digits: Column) -> Column:
    """The checksum of a digit string, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, lit(0), lambda a, x: a + x) % 10


def pick(words: list[str], hexes: Column, at: int) -> Column:
    return F.get(F.array(*map(lit, words)), F.conv(F.substring(hexes, at, 4), 16, 10).cast("int") % len(words))


def script_of(word: Column) -> Column:
    return F.when(F.rlike(word, lit(r"^\p{IsCyrillic}")), "cyrillic").when(F.rlike(word, lit(r"^\p{IsGreek}")), "greek").otherwise("latin")


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The plain surrogate of a plain entity: digits for digits, an address for an address, a lower-case name part."""
    h = bits(key, kind, value, attempt)
    stream, n = digit_stream(h), F.length(value)
    byte = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
    card = F.concat(F.substring(value, 1, 1), F.substring(stream, lit(1), n - 2))
    check = F.pmod(luhn(value) - luhn(F.concat(card, lit("0"))), lit(10)).cast("string")  # the same remainder as before
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    shaped = lambda text, s: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(F.rlike(c, lit("[0-9]")), F.substring(digit_stream(s), i % 60 + 1, lit(1))).when(F.rlike(c, lit("[a-z]")), F.translate(F.substring(s, i % 60 + 1, lit(1)), "0123456789abcdef", "bcdfghjklmnprstv")).when(F.rlike(c, lit("[A-Z]")), F.translate(F.substring(s, i % 60 + 1, lit(1)), "0123456789abcdef", "BCDFGHJKLMNPRSTV")).when(F.rlike(c, lit(r"\p{L}")), F.translate(F.substring(s, i % 60 + 1, lit(1)), "0123456789abcdef", "bcdfghjklmnprstv")).otherwise(c)), "")
    host = F.translate(F.substring(bits(key, lit("domain"), domain, lit(0)), 1, 10), "0123456789abcdef", "bcdfghjklmnprstv")
    longer = F.translate(F.substring(h, 41, 8), "0123456789abcdef", "bcdfghjklmnprstv")  # short names leave too little room
    email = F.concat(shaped(local, h), F.when((F.length(local) < 10) | (attempt > 0), longer).otherwise(""), lit("@"), host, lit(".example."), F.substring_index(domain, ".", -1))
    iban = F.concat(F.substring(value, 1, 2), shaped(F.substring(value, lit(3), n), h))
    part = None
    for script, syllables in SYLLABLES.items():
        sound = lambda at: pick(syllables, h, at)  # noqa: B023, E731
        surname = F.concat(sound(1), sound(5), sound(9), F.when(attempt > 0, F.concat(sound(13), sound(17))).otherwise(""), F.when(attempt > 1, F.concat(sound(21), sound(25))).otherwise(""))
        more = F.when(attempt > 0, F.concat(sound(29), sound(33))).otherwise("")
        for which, made in (("surname", surname), *((f"given_{g}", F.concat(F.lower(pick(GIVEN[script, g], h, 1)), more)) for g in "mfn")):
            case = (kind == which) & (script_of(value) == script)
            part = F.when(case, made) if part is None else part.when(case, made)
    return (
        part.when(kind == "email", email).when(kind == "iban", iban).when(kind == "ssn", F.substring(stream, 1, 9))
        .when((kind == "ip") & F.contains(value, lit(":")), F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(h, i + 1, lit(1)))), ""))
        .when(kind == "ip", F.concat_ws(".", byte(1) % 223 + 1, byte(3), byte(5), byte(7) % 254 + 1)).when(kind == "card", F.concat(card, check))
        .otherwise(F.substring(stream, lit(1), n))
    )


def formatted(m: Column, digits: Column) -> Column:
    """m with its digits replaced in turn; what is left of digits follows at the end."""
    start = F.struct(lit("").alias("s"), lit(1).alias("i"))
    step = lambda a, c: F.struct(F.concat(a["s"], F.when(F.rlike(c, lit("[0-9]")), F.substring(digits, a["i"], lit(1))).otherwise(c)).alias("s"), (a["i"] + F.rlike(c, lit("[0-9]")).cast("int")).alias("i"))
    return F.aggregate(F.split(m, ""), start, step, lambda a: F.concat(a["s"], F.substring(digits, a["i"], F.length(digits))))


def cased(like: Column, word: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(word)).when(like == F.lower(like), word).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, lit(2), F.length(word))))


def styled(m: Column, address: Column) -> Column:
    """An address with capitals where m has them before the @, and a capital after it if m has one there."""
    part = lambda a, n: F.substring_index(a, "@", n)
    capital = lambda a, i: F.rlike(F.substring(a, i, lit(1)), lit("[A-Z]"))
    local = F.array_join(F.transform(F.split(part(address, 1), ""), lambda c, i: F.when(capital(part(m, 1), i + 1), F.upper(c)).otherwise(c)), "")
    return F.concat(local, lit("@"), F.when(capital(part(m, -1), lit(1)), F.initcap(part(address, -1))).otherwise(part(address, -1)))


def gender_of(title: Column, given: Column) -> Column:
    """m, f, or n where neither title nor given name tells. In Cyrillic and Greek script endings do."""
    title, given = F.lower(F.regexp_replace(title, r"\.$", "")), F.lower(given)
    among = lambda names: given.isin(*dict.fromkeys(n.lower() for n in names))
    men, women = ([n for (_, g), names in GIVEN.items() if g == which for n in names] for which in "mf")
    return (
        F.when(title.isin(*(t.lower() for t in MALE)), "m").when(title.isin(*(t.lower() for t in FEMALE)), "f")
        .when(among((*men, *KNOWN_MALE)), "m").when(among((*women, *KNOWN_FEMALE)), "f")
        .when(script_of(given) == "cyrillic", F.when(F.rlike(given, lit("[ая]$")), "f").otherwise("m"))
        .when(script_of(given) == "greek", F.when(F.rlike(given, lit("ς$")), "m").otherwise("f")).otherwise("n")
    )


def name_parts(m: Column) -> Column:
    """The words of an honorific and a name, and what stands between them: text and kind ('' for the honorific, particles and
    separators). What follows the last blank is the surname, hyphenated or not."""
    tokens = F.regexp_extract_all(m, lit(r"[\p{L}.'’]+|[^\p{L}.'’]+"), lit(0))
    rest = lambda i: F.slice(tokens, i + 2, F.size(tokens))
    blank = lambda t: F.rlike(t, lit(r"\s"))
    named = lambda t, i: (i > 0) & F.rlike(t, lit(r"^\p{Lu}"))
    first = F.get(F.filter(tokens, named), lit(0))
    gender = gender_of(F.get(tokens, lit(0)), first)
    return F.transform(tokens, lambda t, i: F.struct(t.alias("text"), F.when(~named(t, i), "").when(F.exists(rest(i), blank), F.concat(lit("given_"), gender)).otherwise("surname").alias("kind")))


def entities_of(m: Column) -> Column:
    """The entities in one match: (kind, value)."""
    entity = lambda kind, value: F.struct(kind.alias("kind"), value.alias("value"))
    parts = F.transform(F.filter(name_parts(m), lambda p: p["kind"] != ""), lambda p: entity(p["kind"], F.lower(p["text"])))
    kind = kind_of(m)
    return F.when(kind == "name", parts).otherwise(F.array(entity(kind, plain(kind, m))))


def matches(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.rlike(text, lit(LIKELY)), F.regexp_extract_all(text, lit(PATTERN), lit(0))).otherwise(none)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) of the entities that need one above 0: drawn again until all surrogates are distinct."""
    state = entities.withColumn("attempt", lit(0))
    for turn in range(ROUNDS + 1):
        made = state.withColumn("made", surrogate(key, F.col("kind"), F.col("value"), F.col("attempt")))
        group = F.when(F.startswith(F.col("kind"), lit("given")), "given").otherwise(F.col("kind"))
        first = made.groupBy(group.alias("_g"), F.col("made").alias("_m")).agg(F.count("*").alias("_n"), F.min(F.struct("attempt", "kind", "value")).alias("_first"))
        real = entities.select(group.alias("_g"), F.col("value").alias("_m"), lit(True).alias("_real")).distinct()
        clash = first.join(real, ["_g", "_m"], "left").filter("_n > 1 or _real")
        bad = made.join(clash, (group == F.col("_g")) & (F.col("made") == F.col("_m")))
        bad = bad.filter(F.col("_real") | (F.struct("attempt", "kind", "value") != F.col("_first")))
        bad = written(bad.select("kind", "value", F.lit(1).alias("_bad")), "clashes")
        if bad.isEmpty():
            break
        if turn == ROUNDS:
            raise ValueError(f"no room for distinct surrogates of {bad.count()} entities, one of kind {bad.first().kind}")
        state = state.join(bad, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("_bad", lit(0))).drop("_bad")
        state = written(state, "attempts")
    return state.filter("attempt > 0")


def surrogates(entities: Column, tries: Column, key: str) -> Column:
    """The surrogate of each of an array of entities."""
    tried = lambda e: F.coalesce(F.try_element_at(tries, F.concat(e["kind"], lit(":"), e["value"])), lit(0))
    return F.transform(entities, lambda e: surrogate(key, e["kind"], e["value"], tried(e)))


def replaced(around: Column, found: Column, made) -> Column:
    """The text between matches, and the matches replaced; made(kind, value): the surrogate of an entity."""

    def one(m: Column) -> Column:
        kind = kind_of(m)
        name = F.array_join(F.transform(name_parts(m), lambda p: F.when(p["kind"] == "", p["text"]).otherwise(cased(p["text"], made(p["kind"], F.lower(p["text"]))))), "")
        other = made(kind, plain(kind, m))
        spaced = F.when(F.contains(m, lit(" ")), F.trim(F.regexp_replace(other, "(.{4})", "$1 "))).otherwise(other)
        abroad = F.greatest(F.length(F.regexp_replace(m, r"\D", "")) - NATIONAL, lit(0))
        code = F.when(kind == "phone", F.substring(F.regexp_replace(m, r"\D", ""), lit(1), abroad)).otherwise("")
        return (
            F.when(kind == "name", name).when(kind.isin("card", "phone", "ssn"), formatted(m, F.concat(code, other)))
            .when(kind == "iban", spaced).when(kind.isin("email", "ip") & (m == F.upper(m)), F.upper(other))
            .when((kind == "email") & (m != F.lower(m)), styled(m, other)).otherwise(other)
        )

    return F.concat(F.get(around, lit(0)), F.array_join(F.transform(found, lambda m, i: F.concat(one(m), F.get(around, i + 1))), ""))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, and n_<kind> for each of KINDS. Who has the secret key can tell an entity's surrogate."""
    if not key:
        raise ValueError("a secret key is needed")
    docs, back = set_aside(docs, "text", made=[f"n_{k}" for k in KINDS])
    found = docs.select("text", matches(text_or_empty()).alias("_pii"))
    each = found.filter(F.size("_pii") > 0).select(F.xxhash64("text").alias("_h1"), F.xxhash64(lit("second"), "text").alias("_h2"), F.explode(F.flatten(F.transform("_pii", entities_of))).alias("_e"))
    held = written(each.select("_h1", "_h2", "_e.kind", "_e.value").distinct(), "entities")
    odd = written(attempts(written(held.select("kind", "value").distinct(), "distinct"), key), "exceptions")
    x = docs.withColumn("_pii", matches(text_or_empty()))
    tries = lit(None).cast("map<string,int>")
    if not odd.isEmpty():
        table = held.join(odd, ["kind", "value"]).groupBy("_h1", "_h2").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", lit(":"), "value"), "attempt"))).alias("_pii_tries"))
        table = written(table, "tries").withColumnsRenamed({"_h1": "_pii1", "_h2": "_pii2"})
        x = x.join(table, (F.xxhash64("text") == F.col("_pii1")) & (F.xxhash64(lit("second"), "text") == F.col("_pii2")), "left")
        tries = F.col("_pii_tries")
    some = F.size("_pii") > 0
    x = x.withColumn("_pii_who", F.when(some, F.array_distinct(F.flatten(F.transform("_pii", entities_of)))))
    x = x.withColumns({"_pii_made": surrogates(F.col("_pii_who"), tries, key), "_pii_around": F.when(some, F.split("text", PATTERN, -1))})
    made = lambda kind, value: F.get("_pii_made", (F.array_position("_pii_who", F.struct(kind.alias("kind"), value.alias("value"))) - 1).cast("int"))
    x = x.withColumn("_pii_text", F.when(some, replaced(F.col("_pii_around"), F.col("_pii"), made)).otherwise(F.col("text")))
    # bare mentions of given names and surnames follow, as first written, in capitals, or with capital initials. They hold
    # letters and apostrophes only, so they are their own patterns; long ones go first, as they may hold others. The text is
    # read once for all of them.
    parts = F.filter(F.flatten(F.transform(F.filter("_pii", lambda m: kind_of(m) == "name"), name_parts)), lambda p: p["kind"] != "")
    initials = lambda w: F.regexp_replace(F.initcap(F.regexp_replace(F.lower(w), "(['’])", "$1 ")), "(['’]) ", "$1")
    forms = F.array_distinct(F.flatten(F.transform("_pii_parts", lambda p: F.array(p["text"], initials(p["text"]), F.upper(p["text"])))))
    sorted_forms = F.array_sort(F.transform(forms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    pattern = F.concat(lit(r"(?<!\p{L})(?:"), F.array_join(F.transform(sorted_forms, lambda f: f["w"]), "|"), lit(r")(?!\p{L})"))
    x = x.withColumn("_pii_parts", F.array_distinct(parts))
    some_names = F.size("_pii_parts") > 0
    x = x.withColumn("_pii_forms", F.when(some_names, pattern))
    x = x.withColumns({
        "_pii_low": F.transform("_pii_parts", lambda p: F.lower(p["text"])), "_pii_bare": F.regexp_extract_all("_pii_text", F.col("_pii_forms"), lit(0)),
        "_pii_between": F.split("_pii_text", F.col("_pii_forms"), -1),
    })

    def renamed(m: Column) -> Column:
        p = F.get("_pii_parts", (F.array_position("_pii_low", F.lower(m)) - 1).cast("int"))
        return cased(m, made(p["kind"], F.lower(m)))

    follow = F.concat(F.get("_pii_between", lit(0)), F.array_join(F.transform("_pii_bare", lambda m, i: F.concat(renamed(m), F.get("_pii_between", i + 1))), ""))
    text = F.when(some_names, follow).otherwise(F.col("_pii_text"))
    kinds = F.transform("_pii", kind_of)
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    return back(x.withColumns({"text": text, **counts}))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), session_key(spark))


def private_documents(docs: DataFrame) -> DataFrame:
    """docs with surrogates by the session's key; n_chars follows the text."""
    safe, back = set_aside(docs, "text", "n_chars")
    x = with_surrogates(safe, session_key(docs.sparkSession))
    if "n_chars" in docs.columns:
        x = x.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(x)
