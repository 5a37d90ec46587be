"""Personal data replaced by keyed surrogates: DataFrame functions only.

Detected entities are brought to a canonical value (an email in lower case, a phone number
without its country, a name in lower case), and each distinct (kind, value) gets one surrogate of
the same type in the whole corpus, made from a keyed hash: so equal values keep referring to the
same thing, in whatever format they are written. Persons are found by title, by first name and
by what stands before a name; then every further mention of those first names and surnames
in the same text is found too. A first name has one surrogate whatever title it comes with; its
gender is what most mentions in the corpus say. A surrogate must differ from every surrogate
given before and from every real value of its kind, else the next hash is tried, and where a
format has too few values, the surrogate grows. It is then dressed like the original: its
separators and case, its script, a person's gender, a card's or IBAN's check digits, the country
code of a phone number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions.text import once, quoted, spans
from umbra.operators.detect import MATCHES
from umbra.operators.resolve import resolve

from .shared import cut, join_small

KINDS = ("email", "phone", "card", "ssn", "ip", "iban", "first", "surname")
GENDERS = ("female", "male")
#: Attempts in a value's own format; further ones are longer.
TRIES = 12

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_TAIL = r"[\s.-]?[0-9]{3,4}[\s.-]?[0-9]{3,4}"
#: kind, confidence where entities overlap, regex gate, pattern
NUMBERS = (
    ("email", 0.95, "@", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}"),
    ("iban", 0.94, r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", 0.9, r"[0-9](?:[ -]?[0-9]){12}", r"\b[0-9](?:[ -]?[0-9]){12,18}\b"),
    ("ssn", 0.85, r"[0-9]-[0-9]{2}-[0-9]", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("ip", 0.8, r"[0-9]\.[0-9]", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.[0-9])"),
    ("phone", 0.7, r"[+(][0-9]|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", rf"(?<!\w)(?:\+[0-9]{{1,3}}[\s.-]?\(?[0-9]{{1,4}}\)?{_TAIL}|\([0-9]{{2,4}}\){_TAIL}|[0-9]{{3}}([ .-])[0-9]{{3}}\1[0-9]{{4}}|\+[0-9]{{8,15}})(?!\w)"),
)

# Titles by gender, and first names by gender and script.
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Signora г-жа κυρία".split()
MALE_TITLES = "Mr Herr Monsieur Señor Sr Don Signor г-н κύριος".split()
OTHER_TITLES = "Dr Prof".split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Emma Olivia Anna Maria Laura Julia Katharina Ursula "
    "Sabine Claire Camille Chloé Françoise Carmen Lucía Sofía Isabel Hannah Alice Charlotte Sophie Margaret Dorothy Helen Ruth Sharon Michelle "
    "Amanda Melissa Stephanie Rebecca Kathleen Amy Angela Brenda Nicole Samantha Katherine Heike Petra Monika Brigitte Ingrid Renate Anja "
    "Nathalie Isabelle Juliette Élodie Amélie Aurélie Pilar Dolores Rosario Guadalupe Elena Marta Giulia Chiara Francesca Priya Ananya Aisha "
    "Fatima Leila Yasmin Mei Xiu Yuki Sakura Hana Nguyet Amina Zainab Ngozi Agnieszka Katarzyna Zofia Анна Мария Елена Ольга Наталья Татьяна "
    "Ирина Светлана Ελένη Μαρία Αικατερίνη Σοφία"
).split()
MALE_NAMES = (
    "James Robert John Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Jürgen Wolfgang Klaus Stefan "
    "Pierre Jacques François Étienne Carlos José Javier Miguel Alejandro Christopher Anthony Steven Andrew Kenneth Joshua Kevin Brian George "
    "Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory "
    "Alexander Patrick Dieter Helmut Günther Horst Uwe Matthias Sebastian Laurent Olivier Philippe Thierry Guillaume Antonio Francisco Manuel "
    "Pablo Diego Giovanni Marco Luca Ahmed Mohammed Muhammad Omar Hassan Ali Ibrahim Wei Hiroshi Kenji Takashi Rajesh Sanjay Arjun Vikram "
    "Chinedu Kwame Piotr Krzysztof Jan Sven Lars Olaf Иван Александр Сергей Дмитрий Андрей Николай Владимир Михаил Γιώργος Δημήτρης Νίκος Κώστας"
).split()
#: What stands right before a person's full name.
CUES = "Dear|Hello|Hi|Sincerely,|Regards,|[Mm]y name is|I am|[Ss]igned by|[Nn]ame:|[Cc]ontact:|Liebe|Lieber|[Ii]ch heiße|[Mm]ein Name ist|Chère|Cher|[Jj]e m'appelle|Querida|Querido|[Mm]e llamo|Уважаемый|Уважаемая|[Мм]еня зовут"
#: Honorifics after a name, in scripts without capitals: (characters of a name, honorific, gender or "").
HONORIFICS = ((r"\p{IsHan}{2,3}", "先生", "male"), (r"\p{IsHan}{2,3}", "(?:女士|小姐)", "female"), (r"(?:\p{IsHan}|\p{IsKatakana}){2,4}", "(?:さん|様)", ""), (r"\p{IsHangul}{2,4}", " ?씨", ""))
# Syllables and endings by gender, of invented names in each script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga ka ke ko la le li lo ma me mi mo na ne ni no pa ra re ri ro sa se ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе бо да де до ва ве ви га ка ко ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти то за".split(),
    "greek": "βα βε δα δε δο γα κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε τι το φα φι".split(),
    "han": "安 波 成 东 方 光 海 和 华 江 金 克 兰 林 明 宁 平 青 瑞 山 石 松 天 文 西 新 阳 永 云 泽".split(),
    "kana": "ア カ キ サ シ タ ナ ニ ノ マ ミ モ ヤ ユ ラ リ レ".split(),
    "hangul": "가 나 다 라 마 바 사 아 자 하 기 니 미 리 시 지 소 수 유 주".split(),
}
ENDINGS = {
    "latin": {"female": "la na ra".split(), "male": "ro rd ns".split(), "": "lin ren sel".split(), "surname": "ner man son".split()},
    "cyrillic": {"female": "на ла ра".split(), "male": "лан мир рий".split(), "": "ша ня ля".split(), "surname": "вич нко дзе".split()},
    "greek": {"female": "να λα ρα".split(), "male": "λος νος ρης".split(), "": "λι νι ρι".split(), "surname": "δης λου κης".split()},
}
_IN_SCRIPT = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "kana": r"\p{IsKatakana}", "hangul": r"\p{IsHangul}", "han": r"\p{IsHan}"}

_NAME = r"\p{Lu}\p{L}+(?:[-'’]\p{Lu}\p{L}+)?"


def _person_spans(text: Column, pattern: str, group: int, kind: str, confidence: float, gender: str = "") -> Column:
    """Group ``group`` of each match of ``pattern``, whose groups before it are one after another."""

    def shaped(s: Column) -> Column:
        value = F.rtrim(F.regexp_extract(s["value"], pattern, group))
        before = reduce(lambda a, g: a + F.length(F.regexp_extract(s["value"], pattern, g)), range(1, group), s["start"] + F.lit(0))
        return _match(before, before + F.length(value), kind, value, confidence, gender)

    return F.filter(F.transform(spans(text, pattern), shaped), lambda m: m["end"] > m["start"]).cast(MATCHES)


def _match(start: Column, end: Column, kind: str, value: Column, confidence: float, gender: str = "") -> Column:
    """A match; its label is the gender that the mention tells, if any."""
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"),
        F.lit(gender).alias("label"), value.alias("value"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("detector"),
    )


def iban_ok(value: Column) -> Column:
    """Whether the check digits of an IBAN (upper case, no blanks) hold."""
    return F.length(value).between(15, 34) & (_mod97(F.concat(F.substr(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1)


def _mod97(value: Column) -> Column:
    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, (rest * 100 + n - 55) % 97).otherwise((rest * 10 + n - 48) % 97)

    return F.aggregate(F.regexp_extract_all(value, F.lit("."), F.lit(0)), F.lit(0), step)


def find(text: Column, female: Sequence[str] = FEMALE_NAMES, male: Sequence[str] = MALE_NAMES) -> Column:
    """The entities of a text as an array of matches, sorted and not overlapping; a null text has none.

    Most texts hold no digit, or no capitalised word that is a title, a cue or a first name, and cost one look for each.
    """
    none, numbers = F.array().cast(MATCHES), []
    for kind, confidence, gate, pattern in NUMBERS:
        hits = spans(text, "(?U)" + pattern)
        if kind == "card":
            hits = F.filter(hits, lambda s: F.call_function("luhn_check", F.regexp_replace(s["value"], "[ -]", "")))
        if kind == "iban":
            hits = F.filter(hits, lambda s: iban_ok(F.regexp_replace(s["value"], " ", "")))
        numbers.append(F.when(text.rlike(gate), F.transform(hits, _shaper(kind, confidence)).cast(MATCHES)).otherwise(none))
    email, others = numbers[0], numbers[1:]
    return resolve(F.concat(email, F.when(text.rlike("[0-9]"), F.concat(*others)).otherwise(none), persons(text, female, male)))


def persons(text: Column, female: Sequence[str], male: Sequence[str]) -> Column:
    """Mentions of persons: by title, cue, first name and honorific."""
    none, titled, named, marked = F.array().cast(MATCHES), [], [], []
    for gender, titles in (("female", FEMALE_TITLES), ("male", MALE_TITLES), ("", OTHER_TITLES)):
        title = rf"(?U)((?<!\w)(?:{'|'.join(titles)})\.?[ ])({_NAME}[ ])?({_NAME})"
        titled += [_person_spans(text, title, 2, "first", 0.6, gender), _person_spans(text, title, 3, "surname", 0.6)]
    cue = rf"(?U)((?<!\w)(?:{CUES}) )({_NAME})([ ])({_NAME})(?!\w)"
    titled += [_person_spans(text, cue, 2, "first", 0.59), _person_spans(text, cue, 4, "surname", 0.59)]
    for gender, names in (("female", female), ("male", male)):
        known = "|".join(rf"\Q{n}\E" for n in names)
        full = rf"(?U)((?<![\w-])(?:{known}))([ ])({_NAME})"
        named += [_person_spans(text, full, 1, "first", 0.61, gender), _person_spans(text, full, 3, "surname", 0.58)]
        named += [_person_spans(text, rf"(?U)((?<![\w-])(?:{known})(?![\w-]))", 1, "first", 0.58, gender)]
    for name, honorific, gender in HONORIFICS:
        marked.append(_person_spans(text, rf"({name})({honorific})", 1, "surname", 0.6, gender))
    # a word that is none of these is looked at once
    words = F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{L}'-]+"), F.lit(0))
    cues = r"\p{L}[.,:]? \p{Lu}\p{L}+ \p{Lu}|(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + r")\.? \p{Lu}"
    some = F.arrays_overlap(F.transform(words, lambda w: F.regexp_extract(w, "^[^'-]+", 0)), F.array(*map(F.lit, [*female, *male])))
    capitals = text.rlike(r"\p{Lu}\p{L}")
    return F.concat(
        F.when(capitals & text.rlike(cues), F.concat(*titled)).otherwise(none),
        F.when(capitals & some, F.concat(*named)).otherwise(none),
        F.when(text.rlike("先生|女士|小姐|さん|様|씨"), F.concat(*marked)).otherwise(none),
    )


def mentions(text: Column, found: Column) -> Column:
    """``found`` and every other place where the text holds one of its first names or surnames by itself."""
    more = []
    for kind in ("first", "surname"):
        values = F.array_distinct(F.transform(F.filter(found, lambda m: m["kind"] == kind), lambda m: m["value"]))  # noqa: B023
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_-])(?:"), F.array_join(F.transform(values, quoted), "|"), F.lit(r")(?![\p{L}\p{N}_]|-\p{L})"))
        places = F.transform(spans(text, pattern), _shaper(kind, 0.5)).cast(MATCHES)
        more.append(F.when(F.size(values) > 0, places).otherwise(F.array().cast(MATCHES)))
    return F.when(F.exists(found, lambda m: m["kind"].isin("first", "surname")), resolve(F.concat(found, *more))).otherwise(found)


def _shaper(kind: str, confidence: float):
    return lambda s: _match(s["start"], s["end"], kind, s["value"], confidence)


#: Country codes: of one, two and else of three digits.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def canonical(kind: Column, value: Column) -> Column:
    """What two ways to write the same entity have in common; a phone number's digits without country code and trunk zero."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    national = F.when(value.startswith("+"), F.regexp_replace(digits, _COUNTRY, "")).otherwise(digits)
    phone = F.regexp_replace(national, "^0+(?=[0-9]{5})", "")
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "ip", value).otherwise(F.lower(value))


def _stream(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """128 keyed hex digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)


def _number(stream: Column, at: Column, base: int) -> Column:
    """A number below ``base`` from the three hex digits at place ``at`` (any whole number)."""
    return (F.conv(F.substr(stream, (at * 3) % 123 + 1, F.lit(3)), 16, 10).cast("int") % base).cast("int")


def _digits(stream: Column, n: Column) -> Column:
    """``n`` digits."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: _number(stream, i, 10).cast("string")), "")


def _like(stream: Column, value: Column) -> Column:
    """Letters for letters and digits for digits, other characters as they are; letters of the Latin alphabet stay in it."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))

    def other(c: Column, i: Column) -> Column:
        n = _number(stream, i, 2600)
        latin, cyrillic, greek = (F.char(F.lit(97) + n % 26), F.substr(F.lit("абвгдежзиклмнопрстуф"), n % 20 + 1, F.lit(1)), F.substr(F.lit("αβγδεζηθικλμνξοπρστυ"), n % 20 + 1, F.lit(1)))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), cyrillic).when(c.rlike(r"\p{IsGreek}"), greek).when(c.rlike(r"\p{L}"), latin).otherwise(c)

    return F.array_join(F.transform(chars, other), "")


def _luhn_digit(payload: Column) -> Column:
    n = F.length(payload)

    def step(total: Column, i: Column) -> Column:
        d = F.substr(payload, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)
    return ((10 - total % 10) % 10).cast("string")


def _script(value: Column) -> Column:
    out = F.lit("latin")
    for script, letters in reversed(_IN_SCRIPT.items()):
        out = F.when(value.rlike(letters), F.lit(script)).otherwise(out)
    return out


def _pick(words: list[str], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, words)), n % len(words))


def _invented(kind: Column, gender: Column, value: Column, stream: Column, more: Column) -> Column:
    """A name in the value's script, with an ending of its gender where the script's table has one; ``more`` further syllables."""
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        # other scripts have no endings, and one syllable a character: as many as the value has, then more
        count = more + 1 if script in ENDINGS else F.greatest(F.length(value) - 1, F.lit(1)) + more - 1
        body = F.array_join(F.transform(F.sequence(F.lit(0), count), lambda i: _pick(syllables, _number(stream, i + 3, 4096))), "")  # noqa: B023
        if script not in ENDINGS:
            out = F.when(_script(value) == script, body).otherwise(out)
        for of, endings in ENDINGS.get(script, {}).items():
            mine = kind == "surname" if of == "surname" else (kind == "first") & (gender == of)
            out = F.when((_script(value) == script) & mine, F.concat(body, _pick(endings, _number(stream, F.lit(1), 4096)))).otherwise(out)
    return out


def surrogate(kind: Column, value: Column, gender: Column, attempt: int, key: str) -> Column:
    """The surrogate (in canonical form) of a canonical value at an attempt."""
    s = _stream(kind, value, F.lit(attempt), key)
    n = F.length(value)
    some = _digits(s, n)
    more = max(0, attempt - TRIES)  # beyond, a format's own values may be used up
    longer = _digits(F.sha2(s, 512), F.lit(more)) if more else F.lit("")
    card = F.concat(F.substring(value, 1, 1), F.substr(some, F.lit(2), n - 2))
    phone = F.concat((_number(s, F.lit(0), 8) + 2).cast("string"), F.substr(some, F.lit(2), n - 1), longer)
    # addresses for private use at first, then any
    first = F.lit("10") if attempt < 4 else _number(s, F.lit(7), 256).cast("string")
    ip = F.concat(F.concat_ws(".", first, *(_number(s, F.lit(i), 256).cast("string") for i in range(3))), F.concat(F.lit("."), longer) if more else F.lit(""))
    area = F.lit("9") if attempt < 4 else _number(s, F.lit(7), 10).cast("string")
    bban = F.concat(F.upper(_like(s, F.lower(F.substr(value, F.lit(5), n)))), longer)
    check = F.lpad((98 - _mod97(F.concat(bban, F.substring(value, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    extra = _digits(F.sha2(s, 512), F.lit(attempt - 2)) if attempt > 2 else F.lit("")  # short addresses run out
    host = F.regexp_replace(domain, r"\.[^.]*$", "")
    email = F.concat(_like(s, local), extra, F.lit("@"), _like(F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), host), 512), host), F.lit("."), F.regexp_extract(domain, r"[^.]*$", 0))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", F.concat(card, _luhn_digit(card), longer))
        .when(kind == "ssn", F.concat(area, F.substr(some, F.lit(2), n - 1), longer)).when(kind == "ip", ip).when(kind == "iban", F.concat(F.substring(value, 1, 2), check, bban))
        .otherwise(_invented(kind, gender, value, s, F.lit(max(0, attempt - 2) + 1)))
    )


def dress(kind: Column, value: Column, made: Column) -> Column:
    """The surrogate ``made`` written like the original ``value``."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    letters = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
    kept = F.when(kind == "phone", F.greatest(letters - F.length(made), F.lit(0))).otherwise(F.lit(0))  # digits of the country

    def put(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), "[^0-9A-Za-z]", "")) - kept
        return F.when(c.rlike("[0-9A-Za-z]") & (place > 0), F.substr(made, place, F.lit(1))).otherwise(c)

    rest = F.substr(made, letters - kept + 1, F.length(made))  # of a surrogate that grew
    spaced = F.concat(F.array_join(F.transform(chars, put), ""), rest)
    named = F.when((F.upper(value) == value) & (F.lower(value) != value) & (F.length(value) > 1), F.upper(made)).when(kind == "email", made).otherwise(F.initcap(made))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind == "ip", made).otherwise(named)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, made) for distinct (kind, value, gender): no two of a kind share a surrogate, and none is a real value of its kind.

    Each round keeps, of those that want the same surrogate, the one whose value comes first,
    and lets the others try again. Few do; and since surrogates grow in the end, all get one.
    """
    real = entities.select("kind", F.col("value").alias("made"))
    waiting, given, attempt = entities.select("kind", "value", "gender"), [], 0
    while True:
        tried = waiting.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("gender"), attempt, key))
        free = tried.join(real, ["kind", "made"], "left_anti")
        for before in given:
            free = free.join(before.select("kind", "made"), ["kind", "made"], "left_anti")
        given.append(cut(free.groupBy("kind", "made").agg(F.min("value").alias("value"))))
        waiting = cut(waiting.join(given[-1], ["kind", "value"], "left_anti"))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, given)
        if attempt % 4 == 3:  # few tables to look into
            given = [cut(reduce(DataFrame.unionByName, given))]
        attempt += 1


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", female: Sequence[str] = FEMALE_NAMES, male: Sequence[str] = MALE_NAMES) -> DataFrame:
    """``id_col``, ``text`` with surrogates for its entities, and ``entities``: array of struct(kind, start, end) in the original.

    ``female`` and ``male`` are the first names that tell a person without a title. A null text
    stays null and has no entities. Repeated rows are replaced alike; other columns are left
    out; an empty table gives an empty table.
    """
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.xxhash64(id_col, text_col).alias("__row"), F.xxhash64(F.lit(1), text_col, id_col).alias("__copy"))
    found = once(docs, "m", find(F.col("__text"), female, male)).filter(F.size("m") > 0)
    found = once(found, "m", mentions(F.col("__text"), F.col("m"))).select("__row", "__copy", "m")
    found = cut(found.groupBy("__row", "__copy").agg(F.first("m").alias("m")))
    each = found.select("__row", "__copy", F.explode("m").alias("m")).select("__row", "__copy", "m.start", "m.end", "m.kind", F.col("m.label").alias("told"), F.col("m.value").alias("written"), canonical(F.col("m.kind"), F.col("m.value")).alias("value"))
    votes = F.sum(F.when(F.col("told") == "female", 1).when(F.col("told") == "male", -1).otherwise(0))
    gender = F.when(votes > 0, "female").when(votes < 0, "male").otherwise("")
    made = cut(assign(cut(each.groupBy("kind", "value").agg(gender.alias("gender"))), key))
    dressed = join_small(each.drop("told"), made, ["kind", "value"], "inner").withColumn("put", dress(F.col("kind"), F.col("written"), F.col("made")))
    edits = cut(dressed.groupBy("__row", "__copy").agg(F.array_sort(F.collect_list(F.struct("start", "end", "put", "kind"))).alias("edits")))  # of one text
    joined = join_small(docs, edits, ["__row", "__copy"], "left").withColumn("edits", F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,put:string,kind:string>>")))
    e, text = F.col("edits"), F.col("__text")

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(e, i - 1)["end"], F.lit(0))
        return F.concat(F.substr(text, before + 1, x["start"] - before), x["put"])

    tail = F.substr(text, F.get(e, F.size(e) - 1)["end"] + 1, F.length(text))
    new = F.when(F.size(e) == 0, text).otherwise(F.concat(F.array_join(F.transform(e, piece), ""), tail))
    return joined.select(F.col("__id").alias(id_col), new.alias("text"), F.transform(e, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("entities"))
