"""PII surrogates: detected entities get keyed, type-consistent replacements.

One regular expression (an alternation of ``KINDS``) finds the entities of a text; the text is split at
them and joined again with their surrogates. Texts that cheap tests show to hold none are left out first. A
surrogate is a pure function of (key, kind, normal form, attempt): digits stay digits, letters stay letters of their
case and script, card numbers and IBANs stay valid, names keep gender and script. So the same entity always gets the
same surrogate, in every document and format.

A person is a family name, the given names before it and a gender, known by the title. The family name has a
surrogate of its own, so relatives keep a common name, and the given name one among those of the family. Within a
document, a titled mention of the family name alone is the person of that family (and gender) with given
names, if there is one, and later mentions without a title (full name, family or given name) are replaced
alike: the document's names are added to its expression.

Distinct entities must get distinct surrogates, and none may equal an entity of the corpus. The distinct
entities are gathered (pre-aggregated, so a hot entity is one row a task), surrogates that collide are drawn
again with the next attempt until none is left, and the drawn-again ones override the first attempt. They
are few; up to ``MAX_LITERAL`` they travel in the plan, beyond it they are joined. After ``FORM_ATTEMPTS`` the
entity's form is full or nearly so, and each further attempt makes the surrogate longer. That ends for any
number of entities: of those left, the smallest gives way to finitely many strings only, all longer at last.

The key is a parameter, else the session's ``spark.relata.pii.key``; where that is unset, a random one is set for
the session, so that nobody can redo the mapping.

Only column expressions are used. Defined results: null texts stay null, empty ones empty; repeated rows get
equal texts; an empty table gives an empty result; extra columns pass through, but for n_entities and
pii_kinds, which are replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.exprs import let
from relata.llm.store import cut, free

KEY_SETTING = "spark.relata.pii.key"
MAX_LITERAL = 2000
#: Attempts that keep an entity's form; later ones grow.
FORM_ATTEMPTS = 8
#: Parts into which the rows of one text are dealt where drawn-again surrogates are joined.
SALTS = 16

_TITLES_M = r"Mr|Sir|Lord|Herr|Herrn|Señor|Sr|Don|Monsieur|M(?=\.)|г-н|господин|Κύριος"
_TITLES_F = r"Mrs|Ms|Miss|Lady|Frau|Fräulein|Señora|Señorita|Sra|Srta|Doña|Dra|Profesora|Professorin|Madame|Mademoiselle|Mme|Mlle|г-жа|госпожа|Κυρία"
_TITLES_U = r"Dr|Prof|Professor|Profesor|Professeur|Doktor|Docteur"
_TITLE = rf"(?:{_TITLES_M}|{_TITLES_F}|{_TITLES_U})"
_TITLES = rf"(?:{_TITLE}\.? )+"
_TITLE_INITIALS = "[DFHKLMPSгΚ]"

#: What stands between the digits of a phone number, and country codes of one and two digits (others have three).
_GAP = r"[ .()/-]{0,2}"
_CODE_1, _CODE_2 = "[17]", "(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: Numbers with a country code; where its numbers have one length, no more is taken. A signed decimal is none.
_ABROAD = rf"\+(?![0-9]+\.[0-9]+(?![.0-9]))(?:1(?:{_GAP}[0-9]){{10}}|33(?:{_GAP}\(0\))?(?:{_GAP}[0-9]){{9}}|34(?:{_GAP}[0-9]){{9}}|(?:7|{_CODE_2}|[2-9][0-9]{{2}})(?:{_GAP}[0-9]){{6,12}})(?![0-9])"
#: National numbers: area code and number, groups of two after a 0, mobile numbers in groups of three.
_AT_HOME = r"(?<![0-9])(?:0[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|0[1-9][0-9]{1,4}[ /-][0-9]{5,9}|[67][0-9]{2}(?: [0-9]{3} |-[0-9]{3}-)[0-9]{3})(?![0-9]|[.-][0-9])"
_US = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|(?<![0-9(])[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: A name's word (inner capitals, apostrophes but for a possessive), and what may stand before one: initials, particles.
_PARTICLES = "(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|zu|zum|zur|bin|ibn|ter|ten)"
_WORD = r"\p{Lu}(?:(?:['’](?!s(?!\p{L})))?[\p{L}\p{M}])++"
_BEFORE = rf"(?:\p{{Lu}}\.[ -]?|\p{{Lu}} |{_PARTICLES} )*+"

#: What stands before a secret: a name, then = (after which any signs may come) or a colon.
_SECRET_NAME = r"(?<![A-Za-z0-9])(?i:token|secret|password|passwd|pwd|(?:api|access|auth|secret|private|client|encryption)[_-]?key)[\"']?[ ]?"
_QUOTED = r"\"[^\"\s]{8,}+\"|'[^'\s]{8,}+'"

_H = "[0-9A-Fa-f]{1,4}"

#: kind and pattern, in the order in which they are tried at one place.
KINDS: tuple[tuple[str, str], ...] = (
    ("aws_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", rf"{_SECRET_NAME}(?:=[ ]?(?:{_QUOTED}|[\"']?[^\s\"'<>,;()&]{{7,}}[^\s\"'<>,;()&.][\"']?)|:[ ]?(?:{_QUOTED}|[\"']?[A-Za-z0-9_+/-]{{8,}}+[\"']?))"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("ipv6", rf"(?<![0-9A-Za-z:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|:(?::{_H}){{2,7}})(?![0-9A-Za-z:]|\.[0-9])"),
    ("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[3-6][0-9]{12,18}|2[2-7][0-9]{14}|(?:[3-6][0-9]|2[2-7])[0-9]{2}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})|3[0-9]{3}(?: [0-9]{6} [0-9]{4,5}|-[0-9]{6}-[0-9]{4,5}))(?![0-9])"),
    ("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"),
    ("phone", rf"(?<![0-9+])(?:{_ABROAD}|{_US}|{_AT_HOME})"),
    ("name", rf"(?<![\p{{L}}]){_TITLES}{_BEFORE}{_WORD}(?:[ -]{_BEFORE}{_WORD})*+"),
)
PATTERN = "|".join(p for _, p in KINDS)


def may_hold(text: Column) -> Column:
    """False only where no pattern of KINDS can match: signs that each kind needs, at little cost."""
    return (
        text.contains("@")
        | text.rlike(r"[0-9](?:[ .()/-]{0,3}[0-9]){6}")  # cards, phone and social security numbers
        | text.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]")
        | text.rlike(":[0-9A-Fa-f]{0,4}:")
        | text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
        | text.contains("AKIA")
        | (text.rlike("[=:]") & text.rlike(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key)[\"']?[ ]?[=:]"))
        | text.rlike(rf"(?={_TITLE_INITIALS})(?<!\p{{L}}){_TITLE}\.? ")
    )


#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "m"): "Adam Brian Carlos Daniel Emil Felix Georg Henri Ivan Jonas Karl Louis Marco Niels Oscar Paul".split(),
    ("latin", "f"): "Alice Berta Clara Diana Elena Fiona Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Макар Никита Олег Павел Роман Семён".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Ева Зоя Инна Кира Лидия Мария Нина Ольга Полина Раиса Софья".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Ιάσων Κώστας Λουκάς Μάριος Νίκος Πέτρος Σάββας Τάσος Φώτης Χρήστος".split(),
    ("greek", "f"): "Άννα Βάσω Γεωργία Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Όλγα Σοφία Φωτεινή Χρύσα".split(),
}
SYLLABLES = {
    "latin": "bar cor den fal gor hel jan kas lor mar nel por ran sol tar vin".split(),
    "cyrillic": "бар вол гор дан жел зар кон лов мар нов пет рос сол тор фил чер".split(),
    "greek": "βαλ γορ δαν ζακ θεο καλ λαμ μαρ νικ παπ ρον σαρ ταλ φιλ χαρ ψαλ".split(),
}

_HEX = r"^[0-9a-f]+$"


def kind_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _luhn_sum(digits: Column, doubled: Column) -> Column:
    """Sum of the digits, those whose place from the left mod 2 is `doubled` taken twice (cross sum)."""

    def one(a: Column, x: Column, i: Column) -> Column:
        v = x.cast("int")
        return a + F.when(i % 2 == doubled, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    chars = F.transform(F.split(digits, ""), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.aggregate(F.filter(chars, lambda p: p["x"] != ""), F.lit(0), lambda a, p: one(a, p["x"], p["i"]))


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^0-9]", "")


def _iban_rest(plain: Column) -> Column:
    """An IBAN without spaces, modulo 97, its first four characters taken last and letters as 10 to 35."""
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + c.try_cast("int")) % 97).when(c == "", rest).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _ipv6_sides(entity: Column) -> Column:
    """(l, r): the groups before and after "::", or all and none."""
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(x, ":"), lambda g: F.regexp_replace(g, "^0+(?=.)", "")))
    low = F.lower(entity)
    return F.struct(groups(F.substring_index(low, "::", 1)).alias("l"), F.when(low.contains("::"), groups(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>")).alias("r"))


def is_entity(entity: Column, kind: Column) -> Column:
    """False for what has the form of a card number or an IBAN but not its check digits, and for other uses of "::"."""
    n = let(_ipv6_sides(entity), lambda s: F.size(s["l"]) + F.size(s["r"]))
    return (
        F.when(kind == "card", let(_digits(entity), lambda d: _luhn_sum(d, F.length(d) % 2)) % 10 == 0)
        .when(kind == "iban", _iban_rest(F.replace(entity, F.lit(" "), F.lit(""))) == 1)
        .when(kind == "ipv6", ((n == 8) & ~entity.contains("::")) | ((n < 8) & ((n > 2) | F.lower(entity).rlike("^(?:fe80|f[cd][0-9a-f]{2}|[23][0-9a-f]{3}):"))))
        .otherwise(kind.isNotNull())
    )


#: A trunk 0 that isn't dialled after the country code.
_TRUNK = r"^(\+[0-9]{1,3}[ .]?)\(0\)"


def _is_abroad(entity: Column) -> Column:
    return entity.startswith("+") & ~entity.startswith("+1")


def _is_at_home(entity: Column) -> Column:
    return entity.rlike(rf"^(?:{_AT_HOME})$") & ~entity.rlike(rf"^(?:{_US})$")


_SECRET_START, _SECRET_END = rf"^{_SECRET_NAME}[=:][ ]?[\"']?", r"[\"']?$"


def normal_form(entity: Column, kind: Column) -> Column:
    """Equal for the spellings of one entity; of persons, see _mentions()."""
    phone = let(
        F.substring_index(entity, " x", 1),
        lambda e: F.when(_is_abroad(e), F.concat(F.lit("+"), _digits(F.regexp_replace(e, _TRUNK, "$1")))).when(_is_at_home(e), F.concat(F.lit("n"), _digits(e))).otherwise(F.right(_digits(e), F.lit(10))),
    )
    ipv6 = let(_ipv6_sides(entity), lambda s: F.array_join(F.concat(s["l"], F.array_repeat(F.lit("0"), 8 - F.size(s["l"]) - F.size(s["r"])), s["r"]), ":"))
    return (
        F.when(kind.isin("email", "family"), F.lower(entity))
        .when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "ipv6", ipv6)
        .when(kind == "phone", F.concat(phone, F.regexp_extract(entity, " (x[0-9]+)$", 1)))
        .when(kind == "secret", F.regexp_replace(F.regexp_replace(entity, _SECRET_START, ""), _SECRET_END, ""))
        .otherwise(entity)
    )


def _stream(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """256 hex digits that depend on all arguments."""
    seed = lambda k: F.sha2(F.concat_ws("\x1f", F.lit(f"{key}/{k}"), kind, normal, attempt.cast("string")), 256)
    return F.concat(seed(0), seed(1), seed(2), seed(3))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th number of a stream, 0 to 65535."""
    return F.conv(F.substr(stream, (i % 63) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _array(items: list[str]) -> Column:
    """A constant array, built with few calls."""
    return F.split(F.lit(" ".join(items)), " ")


def _same_class(text: Column, stream: Column, hexa: bool | Column = False) -> Column:
    """text with each letter and digit replaced by a keyed one of its class (letters beyond ASCII by small ones)."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa = F.lit(hexa) if isinstance(hexa, bool) else hexa
    at = lambda alphabet, n: F.substr(F.lit(alphabet), n + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        return (
            F.when(c.rlike("^[0-9]$"), at(digit, n % 10))
            .when(c.rlike("^[A-Z]$"), at(upper, n % 26))
            .when(c.rlike(r"^\p{L}$"), at(lower, n % F.when(hexa, 6).otherwise(26)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _splice(entity: Column, signs: Column, of: str = "^[0-9]$") -> Column:
    """entity with its digits (or what `of` says) replaced, one after the other, by `signs`."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(a: Column, c: Column) -> Column:
        hit = c.rlike(of)
        return F.struct(F.concat(a["s"], F.when(hit, F.substr(signs, a["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (a["k"] + hit.cast("int")).alias("k"))

    return F.aggregate(F.split(entity, ""), start, step, lambda a: a["s"])


def _new_digits(stream: Column, n: int) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (_byte(stream, i) % 10).cast("string")), "")


def _card(normal: Column, stream: Column) -> Column:
    """Same length and first digit (two but for 16 digits from 3 on), keyed middle, valid check digit."""
    kept = F.when(normal.rlike("^[3-6][0-9]{15}$"), 1).otherwise(2)
    body = F.concat(F.left(normal, kept), F.left(_new_digits(stream, 16), F.length(normal) - kept - 1))
    return let(body, lambda b: F.concat(b, ((10 - _luhn_sum(b, (F.length(b) + 1) % 2) % 10) % 10).cast("string")))


def _phone_abroad(entity: Column, normal: Column, stream: Column) -> Column:
    """Country code, trunk 0 and length stay."""
    code = F.regexp_extract(normal, rf"^\+({_CODE_1}|{_CODE_2}|[0-9]{{3}})", 1)
    trunk = F.when(entity.rlike(_TRUNK), "0").otherwise("")
    first = (_byte(stream, F.lit(20)) % 9 + 1).cast("string")
    return _splice(entity, F.concat(code, trunk, first, F.left(_new_digits(stream, 14), F.length(normal) - F.length(code) - 2)))


def _phone(entity: Column, stream: Column) -> Column:
    """The country code stays; area and exchange start with 2 to 9."""
    new = F.concat((_byte(stream, F.lit(10)) % 8 + 2).cast("string"), F.substr(_new_digits(stream, 10), F.lit(2), F.lit(2)), (_byte(stream, F.lit(11)) % 8 + 2).cast("string"), F.substr(_new_digits(stream, 10), F.lit(5), F.lit(6)))
    return let(F.struct(_digits(entity).alias("d"), new.alias("n")), lambda p: _splice(entity, F.concat(F.substr(p["d"], F.lit(1), F.length(p["d"]) - 10), p["n"])))


def _phone_at_home(entity: Column, stream: Column) -> Column:
    """A trunk 0 and the first digit after it stay."""
    return let(_digits(entity), lambda d: _splice(entity, F.concat(F.left(d, F.lit(2)), F.left(_new_digits(stream, 14), F.length(d) - 2))))


def _ssn(stream: Column) -> Column:
    n = lambda i, most: (_byte(stream, F.lit(i)) % most + 1).cast("string")
    return F.concat_ws("-", F.lpad(n(0, 665), 3, "0"), F.lpad(n(1, 99), 2, "0"), F.lpad(n(2, 9999), 4, "0"))


def _picks(items: list[str] | Column, stream: Column, first: int, n: Column) -> Column:
    """n keyed items, one after the other."""
    every = _array(items) if isinstance(items, list) else items
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first) + n - 1), lambda i: F.element_at(every, _byte(stream, i) % F.size(every) + 1)), "")


def _tail(stream: Column, attempt: Column, items: list[str], before: str = "") -> Column:
    """Keyed items, two more with each attempt beyond FORM_ATTEMPTS; until then empty."""
    return F.when(attempt > FORM_ATTEMPTS, F.concat(F.lit(before), _picks(items, stream, 31, 2 * (attempt - FORM_ATTEMPTS)))).otherwise("")


def _iban(entity: Column, normal: Column, stream: Column, more: Column) -> Column:
    """Country and length stay, letters and digits of the account keep their class, the check digits are right."""

    def made(account: Column) -> Column:
        check = F.lpad((98 - _iban_rest(F.concat(F.left(normal, F.lit(2)), F.lit("00"), account))).cast("string"), 2, "0")
        plain = F.concat(F.left(normal, F.lit(2)), check, account)
        return F.concat(_splice(entity, plain, "^[A-Z0-9]$"), F.substr(plain, F.length(normal) + 1))

    return let(F.concat(_same_class(F.substr(normal, F.lit(5)), stream), more), made)


def _ipv6(entity: Column, normal: Column, stream: Column, attempt: Column) -> Column:
    """Groups of zeros stay (but in later attempts), as does what "::" stands for."""
    full = attempt > FORM_ATTEMPTS
    new = F.transform(F.split(normal, ":"), lambda g, i: F.when((g == "0") & ~full, g).otherwise(F.lower(F.hex(_byte(stream, i) % 65535 + 1))))
    short = lambda n: let(_ipv6_sides(entity), lambda s: F.concat(F.array_join(F.slice(n, F.lit(1), F.size(s["l"])), ":"), F.lit("::"), F.array_join(F.slice(n, 9 - F.size(s["r"]), F.size(s["r"])), ":")))
    out = let(new, lambda n: F.when(entity.contains("::") & ~full, short(n)).otherwise(F.array_join(n, ":")))
    return F.when(entity.rlike("[A-F]"), F.upper(out)).otherwise(out)


def _by_script(name: Column, values: dict[str, str]) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), values["cyrillic"]).when(name.rlike(r"\p{IsGreek}"), values["greek"]).otherwise(values["latin"])


def _family(normal: Column, attempt: Column, key: str) -> Column:
    """Four syllables of the name's script, in later attempts two more each."""

    def made(s: Column) -> Column:
        parts = _by_script(normal, {n: " ".join(p) for n, p in SYLLABLES.items()})
        return let(F.split(parts, " "), lambda p: F.initcap(_picks(p, s, 1, 4 + 2 * F.greatest(F.lit(0), attempt - FORM_ATTEMPTS))))

    return let(_stream(key, F.lit("family"), normal, attempt), made)


def _given(normal: Column, attempt: Column, key: str) -> Column:
    """A given name of the person's gender (either, if unknown) and script, none of the person's own; later more of them."""
    gender, own = F.left(normal, F.lit(1)), F.split(F.initcap(F.split_part(normal, F.lit("|"), F.lit(2))), " ")
    names = {g: _by_script(normal, {n: " ".join(x for (of, has), some in GIVEN.items() if of == n and g in (has, "u") for x in some) for n in SYLLABLES}) for g in "mfu"}
    every = F.when(gender == "m", names["m"]).when(gender == "f", names["f"]).otherwise(names["u"])

    def made(p: Column) -> Column:
        one = lambda i: F.element_at(p["names"], _byte(p["s"], i) % F.size(p["names"]) + 1)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), attempt - FORM_ATTEMPTS)), one), "-")

    return let(F.struct(F.array_except(F.split(every, " "), own).alias("names"), _stream(key, F.lit("name"), normal, attempt).alias("s")), made)


def surrogate(entity: Column, kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """What replaces an entity, in the entity's own spelling; of a person ("name"), the given name."""

    def of(s: Column) -> Column:
        domain = F.substring_index(F.lower(entity), "@", -1)
        host = F.regexp_replace(domain, r"\.[a-z]+$", "")
        top = F.regexp_extract(domain, r"(\.[a-z]+)$", 1)
        letters, digits = list("abcdefghijklmnopqrstuvwxyz"), list("0123456789")
        email = F.concat(_same_class(F.substring_index(entity, "@", 1), s), _tail(s, attempt, letters), F.lit("@"), let(_stream(key, F.lit("host"), host, F.lit(0)), lambda h: _same_class(host, h)), top)
        # no octet starts with 0; the first is 1 to 223
        octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(s, i) % F.when(i == 0, 223).otherwise(254) + 1).cast("string"))
        more = _tail(s, attempt, digits, "-")
        phone = F.when(_is_abroad(entity), _phone_abroad(entity, normal, s)).when(_is_at_home(entity), _phone_at_home(entity, s)).otherwise(_phone(entity, s))
        secret = F.concat(F.regexp_extract(entity, rf"({_SECRET_START})", 1), _same_class(normal, s, normal.rlike(_HEX)), _tail(s, attempt, letters), F.regexp_extract(entity, rf"({_SECRET_END})", 1))
        return (
            F.when(kind == "email", email)
            .when(kind == "ipv4", F.concat(F.array_join(octets, "."), more))
            .when(kind == "ipv6", _ipv6(entity, normal, s, attempt))
            .when(kind == "iban", _iban(entity, normal, s, _tail(s, attempt, digits)))
            .when(kind == "card", F.concat(_splice(entity, _card(normal, s)), more))
            .when(kind == "phone", F.concat(phone, _tail(s, attempt, digits, " x")))
            .when(kind == "ssn", F.concat(_ssn(s), more))
            .when(kind == "aws_key", F.concat(F.lit("AKIA"), _same_class(F.substr(entity, F.lit(5)), s), more))
            .when(kind == "secret", secret)
        )

    return F.when(kind == "family", _family(normal, attempt, key)).when(kind == "name", _given(normal, attempt, key)).otherwise(let(_stream(key, kind, normal, attempt), of))


def _person(mention: Column) -> Column:
    """(g, given, family) of a titled mention: gender m, f or u (unknown), names as spelled; given may be empty."""
    title = F.regexp_extract(mention, rf"^({_TITLES})", 1)
    rest = F.regexp_replace(mention, rf"^{_TITLES}", "")
    gender = F.when(title.rlike(rf"(?<!\p{{L}})(?:{_TITLES_F})(?!\p{{L}})"), "f").when(title.rlike(rf"(?<!\p{{L}})(?:{_TITLES_M})(?!\p{{L}})"), "m").otherwise("u")
    parts = rf"^(.*?) ?((?:{_PARTICLES} )*\S+)$"
    return F.struct(gender.alias("g"), F.regexp_extract(rest, parts, 1).alias("given"), F.regexp_extract(rest, parts, 2).alias("family"))


def _same(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def _first(found: Column, otherwise: Column) -> Column:
    return F.coalesce(F.get(F.array_sort(found), F.lit(0)), otherwise)


def _struct(g: Column, given: Column, family: Column) -> Column:
    return F.struct(g.alias("g"), given.alias("given"), family.alias("family"))


def _of_known_gender(p: Column, persons: Column) -> Column:
    """A mention of unknown gender gets that of others with the same full name."""
    same = F.filter(persons, lambda q: _same(q["family"], p["family"]) & _same(q["given"], p["given"]) & (q["g"] != "u"))
    return _struct(F.when(p["g"] == "u", _first(F.transform(same, lambda q: q["g"]), p["g"])).otherwise(p["g"]), p["given"], p["family"])


def _resolved(p: Column, persons: Column) -> Column:
    """The person of a document that a mention means; of a family name alone, that with given names and no other gender."""
    fits = F.filter(persons, lambda q: _same(q["family"], p["family"]) & (q["given"] != "") & ((q["g"] == p["g"]) | (q["g"] == "u") | (p["g"] == "u")))
    named = let(_first(fits, p), lambda q: _struct(F.when(p["g"] == "u", q["g"]).otherwise(p["g"]), q["given"], p["family"]))
    return F.when(p["given"] == "", named).otherwise(_of_known_gender(p, persons))


def _person_normal(p: Column) -> Column:
    return F.concat_ws("|", p["g"], F.lower(p["given"]), F.lower(p["family"]))


def _mentions(docs: DataFrame, text: str) -> DataFrame:
    """docs with __e (entities in order of place), __p (the text's pattern) and __c (its persons); null where there are none."""
    t = F.col(text)
    out = docs.withColumn("__s", F.when(may_hold(t), F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))))
    titled = F.filter("__s", lambda e: e.rlike(rf"^{_TITLES}"))
    named = let(F.transform(titled, _person), lambda every: F.array_distinct(F.transform(every, lambda p: _of_known_gender(p, every))))
    out = out.withColumn("__c", F.when(F.exists("__s", lambda e: e.rlike(rf"^{_TITLES}")), named))
    # untitled mentions: full names, family names, given names (no initials)
    names = F.flatten(F.transform("__c", lambda p: F.array(F.concat_ws(" ", F.when(p["given"] != "", p["given"]), p["family"]), p["family"], p["given"])))
    names = F.filter(F.array_distinct(names), lambda n: (F.length(n) > 1) & ~n.rlike(r"^(?:\p{Lu}\.?[ -]?)+$"))
    longest = F.transform(F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n")))), lambda x: F.concat(F.lit("\\Q"), x["n"], F.lit("\\E")))
    own = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    out = out.withColumn("__p", F.when(F.col("__c").isNotNull(), own))
    every = F.when(F.col("__p").isNotNull(), F.regexp_extract_all(t, F.col("__p"), F.lit(0))).otherwise(F.col("__s"))
    return out.withColumn("__e", F.when(F.size("__s") > 0, every)).drop("__s")


def _found(marked: DataFrame) -> Column:
    """The (kind, normal, entity) of a text of _mentions()."""
    plain = F.filter(F.transform("__e", lambda e: let(kind_of(e), lambda k: F.struct(k.alias("kind"), normal_form(e, k).alias("normal"), e.alias("entity")))), lambda x: (x["kind"] != "name") & is_entity(x["entity"], x["kind"]))
    persons = F.transform(F.transform("__c", lambda p: _resolved(p, F.col("__c"))), lambda p: F.array(F.struct(F.lit("family").alias("kind"), F.lower(p["family"]).alias("normal"), p["family"].alias("entity")), let(_person_normal(p), lambda n: F.struct(F.lit("name").alias("kind"), n.alias("normal"), n.alias("entity")))))
    return F.array_distinct(F.concat(plain, F.coalesce(F.flatten(persons), F.array().cast("array<struct<kind: string, normal: string, entity: string>>"))))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, normal) of all texts, with the smallest spelling of each; persons have a row each for family and given name."""
    marked = _mentions(docs.select(text), text)
    return marked.select(F.explode(_found(marked)).alias("x")).groupBy("x.kind", "x.normal").agg(F.min("x.entity").alias("entity"))


def _drawn_again(ents: DataFrame, key: str) -> DataFrame | None:
    """(kind, normal, attempt) of the entities whose first surrogate can't stand; None if all can.

    Surrogates are compared by normal form, given names within their family. Of those that share one, the
    smallest entity keeps it.
    """
    first = cut(ents.withColumn("attempt", F.lit(0)))
    now = first
    made = let(surrogate(F.col("entity"), F.col("kind"), F.col("normal"), F.col("attempt"), key), lambda m: normal_form(m, F.col("kind")))
    within = F.when(F.col("kind") == "name", F.concat(F.lit("|"), F.split_part("normal", F.lit("|"), F.lit(3)))).otherwise("")
    while True:
        # written, so that the surrogates (long expressions) are planned and made once a round
        drawn = cut(now.withColumn("s", F.concat(made, within)))
        # of each surrogate the smallest holder; a surrogate that is itself an entity has none
        holder = drawn.select("kind", "s", "normal").unionByName(first.select("kind", F.col("normal").alias("s"), F.lit("").alias("normal"))).groupBy("kind", "s").agg(F.min("normal").alias("holder"), F.count("*").alias("n")).where("n > 1")
        bad = cut(drawn.join(holder, ["kind", "s"]).where(F.col("normal") != F.col("holder")).select("kind", "normal"))
        if bad.isEmpty():
            free(drawn, bad)
            break
        again = bad.withColumn("more", F.lit(1))
        new = cut(now.join(again, ["kind", "normal"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("more", F.lit(0))).drop("more"))
        free(drawn, bad)
        if now is not first:
            free(now)
        now = new
    if now is first:
        free(first)
        return None
    out = cut(now.where("attempt > 0").select("kind", "normal", "attempt"))
    free(first, now)
    return out


def session_key(spark: SparkSession) -> str:
    """The session's key; a random one is set if it has none."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def replace_pii(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with surrogates in the text, n_entities (replaced places) and pii_kinds (sorted, comma-joined)."""
    key = key or session_key(docs.sparkSession)
    again = _drawn_again(entities(docs, text), key)
    attempts = None
    if again is not None:
        rows = again.limit(MAX_LITERAL + 1).collect()  # bounded; beyond it the join below
        if len(rows) <= MAX_LITERAL:
            attempts = F.create_map(*[F.lit(x) for r in rows for x in (f"{r.kind}\x1f{r.normal}", r.attempt)])
    t = F.col(text)
    out = _mentions(docs, text)
    if again is not None and attempts is None:
        spelled = out.select(F.xxhash64(text).alias("__h"), F.explode(_found(out)).alias("x")).select("__h", "x.kind", "x.normal").distinct()
        # few of the entities were drawn again, so this join keeps few rows; those of a text come together again
        own = spelled.join(again, ["kind", "normal"]).groupBy("__h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "normal").alias("k"), F.col("attempt").alias("v")))).alias("__a"))
        # rows of one text are dealt to SALTS parts, those without entities to as many as there are
        row = F.monotonically_increasing_id()
        out = out.withColumns({"__h": F.when(F.col("__e").isNotNull(), F.xxhash64(text)).otherwise(F.xxhash64(row)), "__salt": F.when(F.col("__e").isNotNull(), F.pmod(row, F.lit(SALTS))).otherwise(-1)})
        out = out.join(own.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["__h", "__salt"], "left").drop("__h", "__salt")
        attempts = F.col("__a")

    def attempt(kind: str | Column, normal: Column) -> Column:
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\x1f", F.lit(kind) if isinstance(kind, str) else kind, normal)), F.lit(0))

    def family(p: Column) -> Column:
        made = let(F.lower(p["family"]), lambda n: _family(n, attempt("family", n), key))
        return F.when((F.upper(p["family"]) == p["family"]) & (F.length(p["family"]) > 1), F.upper(made)).otherwise(made)

    def given(p: Column) -> Column:
        return let(_person_normal(p), lambda n: _given(n, attempt("name", n), key))

    def titled(e: Column) -> Column:
        return let(_resolved(_person(e), F.col("__c")), lambda p: F.concat(F.regexp_extract(e, rf"^({_TITLES})", 1), given(p), F.lit(" "), family(p)))

    def untitled(e: Column) -> Column:
        """A mention of one of the text's persons: by full name, family name or given name."""
        full = lambda p: F.concat_ws(" ", p["given"], p["family"])
        by = lambda test: F.get(F.array_sort(F.filter("__c", test)), F.lit(0))
        found = F.struct(by(lambda p: (p["given"] != "") & (full(p) == e)).alias("full"), by(lambda p: p["family"] == e).alias("family"), by(lambda p: p["given"] == e).alias("given"))
        person = lambda p: _resolved(p, F.col("__c"))
        return let(
            found,
            lambda f: F.when(f["full"].isNotNull(), let(person(f["full"]), lambda p: F.concat(given(p), F.lit(" "), family(p))))
            .when(f["family"].isNotNull(), family(f["family"]))
            .when(f["given"].isNotNull(), let(person(f["given"]), given)),
        )

    def one(e: Column) -> Column:
        def keyed(p: Column) -> Column:
            good = F.when(p["k"] == "name", True).otherwise(is_entity(e, p["k"]))
            made = F.when(p["k"] == "name", titled(e)).otherwise(surrogate(e, p["k"], p["n"], attempt(p["k"], p["n"]), key))
            made = F.when(p["k"].isNull(), F.coalesce(untitled(e), e)).when(good, made).otherwise(e)
            return F.struct(made.alias("s"), F.when(p["k"].isNull(), "name").when(good, p["k"]).alias("k"))

        return let(let(kind_of(e), lambda k: F.struct(k.alias("k"), normal_form(e, k).alias("n"))), keyed)

    some = F.col("__e").isNotNull()
    out = out.withColumn("__r", F.when(some, F.transform("__e", one)))
    parts = F.when(F.col("__p").isNotNull(), F.split(t, F.col("__p"))).otherwise(F.split(t, PATTERN))
    ends = F.concat(F.transform("__r", lambda s: s["s"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(parts, ends, lambda p, s: F.concat(p, s)), "")
    kinds = F.filter(F.transform("__r", lambda s: s["k"]), lambda k: k.isNotNull())
    return out.withColumns({
        text: F.when(some, whole).otherwise(t),
        "n_entities": F.when(some, F.size(kinds)).otherwise(0).cast("long"),
        "pii_kinds": F.when(some, F.array_join(F.array_sort(F.array_distinct(kinds)), ",")).otherwise(F.lit("")),
    }).drop("__e", "__p", "__c", "__r", "__a")
