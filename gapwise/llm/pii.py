"""PII: surrogates of detected entities that keep type, gender, script and format, keyed so that they keep coreference.

Numbers (phones, cards, IPs, SSNs, IBANs) go through a keyed permutation of the numbers of their format, so that
different ones stay different. E-mails, names and secrets get keyed pseudo-random letters of the same classes. A check
over all distinct entities finds surrogates that two entities share or that are the value of another entity, and gives
the later of them another attempt.

A name is detected after a form of address or a phrase that introduces one, a phone number by its format. A text's
detected names and phones are then looked for in all of it, without title or format, so that no mention is left.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapwise.llm.common import checkpoint, fresh, in_arrow, row_key, texts, without

#: Forms of address by gender, per script. A name after one of them is a person's.
TITLES = {
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "Господин", "Κύριος"],
    "n": ["Dr.", "Prof."],
}
#: Phrases that introduce a person.
PHRASES = ["My name is", "my name is", "Full name:", "Name:", "Ich heiße", "ich heiße", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Меня зовут", "меня зовут"]
_GENDER = {t: g for g, words in TITLES.items() for t in words} | dict.fromkeys(PHRASES, "n")
#: Syllables from which names are built, and endings by gender, per script: of given names, and of surnames.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mi na ne ni pa pe ra re ri ro sa se ta te ti va ve vi".split(),
    "cyrillic": "ба ве го да жа за ка ле ма на по ра се та фе ха бо ви де ко ло ме ни па ро са те ва ри до".split(),
    "greek": "βα γε δα ζη θα κα λε μα νι πα ρο σα τε φι χα βο δε κο λο μι να πε ρα σο τα".split(),
}
ENDINGS = {"latin": {"f": "a", "m": "o", "n": "en"}, "cyrillic": {"f": "а", "m": "ей", "n": "ень"}, "greek": {"f": "α", "m": "ος", "n": "ης"}}
SURNAMES = {"latin": {"f": "en", "m": "en", "n": "en"}, "cyrillic": {"f": "ова", "m": "ов", "n": "енко"}, "greek": {"f": "ου", "m": "ος", "n": "ης"}}
#: Endings of surnames that tell gender, with what they are without it; a family's forms have one root.
_FORMS = {
    "cyrillic": [("ская", "f", "ск"), ("ский", "m", "ск"), ("ова", "f", "ов"), ("ева", "f", "ев"), ("ёва", "f", "ёв"), ("ина", "f", "ин"), ("ов", "m", "ов"), ("ев", "m", "ев"), ("ёв", "m", "ёв"), ("ин", "m", "ин")],
    "greek": [("ου", "f", ""), ("ος", "m", "")],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WITH_DIGITS = re.compile(
    rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,60}|sk-[A-Za-z0-9]{20,80}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w))"
)
_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[^\W_](?:[^\W_]|-){0,62}\.){1,8}(?:[^\W\d_]{2,24}|xn--[A-Za-z0-9-]{2,59})(?![\w-])")
_QUOTED = re.compile(r"""(?i:\b(?:token|secret|password|passwd|api_?key)["']?\s{0,4}[=:]\s{0,4}["'])([^"'\s]{8,200})["']""")
_WORD = r"[^\W\d_]{2,40}(?:-[^\W\d_]{2,40})*"
_NAME = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True)) + rf") ({_WORD})(?: ({_WORD}))?(?!\w)")
#: Country codes of one and of two digits; all others have three (E.164, fixed values).
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Networks whose addresses stay in them (fixed values); all others are one class.
_NETWORKS = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "224.0.0.0/4", "240.0.0.0/4", "0.0.0.0/8")]


#: The attempt of entities whose format is crowded.
ALONE = -1


def _hash(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=32).digest(), "big")


def permuted(value: int, size: int, key: bytes, *tweak: object) -> int:
    """A keyed permutation of 0 .. size - 1: Feistel rounds over a square that covers them, walked until inside."""
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for r in range(8):
            a, b = b, (a + _hash(key, r, b, *tweak)) % side
        value = a * side + b
        if value < size:
            return value


def unpermuted(value: int, size: int, key: bytes, *tweak: object) -> int:
    """The number that permuted() takes there."""
    side = math.isqrt(size - 1) + 1
    while True:
        a, b = divmod(value, side)
        for r in reversed(range(8)):
            a, b = (b - _hash(key, r, a, *tweak)) % side, a
        value = a * side + b
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, attempt: int, *tweak: object) -> int:
    """The number of an attempt: a keyed permutation each; that of ALONE leaves none where it is, as it turns all numbers in one circle."""
    if attempt != ALONE:
        return permuted(value, size, key, *tweak, attempt)
    step = 1 + _hash(key, "step", size, *tweak) % max(1, size - 1)
    while math.gcd(step, size) > 1:
        step += 1
    return unpermuted((permuted(value, size, key, *tweak) + step) % size, size, key, *tweak)


def _digits(text: str, key: bytes, attempt: int, *tweak: object, alike: Callable[[str], object] = len) -> str:
    """The digits permuted among those of their length that are ``alike``."""
    out = text
    while text:
        out = str(moved(int(out), 10 ** len(text), key, attempt, len(text), *tweak)).zfill(len(text))
        if alike(out) == alike(text):
            return out
    return out


def space(kind: str, canon: str) -> tuple[str, int] | None:
    """The values that an entity's surrogate is among, by name, and how many there are at least; null where they have no bound."""
    if kind == "ip":
        net = _network(int(ipaddress.ip_address(canon)))
        return (str(net[0]), net[1]) if net else ("public", 1 << 31)
    if kind == "ssn":
        return "", 10 ** len(canon)
    if kind == "card":
        return f"{canon[0]} {len(canon)}", 10 ** (len(canon) - 2)
    if kind == "phone":
        return f"{len(canon)} {_dialled(canon)}", max(1, 10 ** len(canon) // 10)
    if kind == "iban":
        shape = "".join("0" if c.isdigit() else c for c in canon[4:])
        return f"{canon[:2]} {shape}", 10 ** shape.count("0")
    return None


def _dialled(digits: str) -> object:
    """The class of a national number: of ten digits, whether area and exchange begin with 2 to 9; else whether it begins with 0."""
    return digits[0] in "01" or digits[3] in "01" if len(digits) == 10 else digits[0] == "0"


def country_code(digits: str) -> str:
    """The country code that the digits of an international number begin with."""
    return digits[:1] if digits[:1] in _ONE_DIGIT else digits[:2] if digits[:2] in _TWO_DIGITS else digits[:3]


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return str(98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97).zfill(2)


def _network(n: int) -> tuple[int, int] | None:
    """First address and size of the network of _NETWORKS that an address is in."""
    for net in _NETWORKS:
        if int(net.network_address) <= n <= int(net.broadcast_address):
            return int(net.network_address), net.num_addresses
    return None


def surname_form(word: str) -> tuple[str, str]:
    """Root and gender (n: none) of a surname in lower case."""
    for ending, gender, root in _FORMS.get(script_of(word), ()):
        if word.endswith(ending) and len(word) > len(ending) + 1:
            return word.removesuffix(ending) + root, gender
    return word, "n"


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "\u0400" <= c <= "\u04ff" else "greek" if "\u0370" <= c <= "\u03ff" else "latin"


def _letters(text: str, seed: int) -> str:
    """Random characters of the classes of ``text``: small, capital, hexadecimal if it is all that, digit; others stay."""
    hexadecimal = len(text) >= 32 and all(c in "0123456789abcdef" for c in text.lower())
    out = []
    for c in text:
        if hexadecimal:
            seed, k = divmod(seed, 16)
            out.append("0123456789ABCDEF"[k] if text.isupper() else "0123456789abcdef"[k])
        elif c.isdigit():
            seed, k = divmod(seed, 10)
            out.append(str(k))
        elif c.isalpha():
            seed, k = divmod(seed, 26)
            out.append(chr((65 if c.isupper() else 97) + k))
        else:
            out.append(c)
        if seed < 1 << 32:
            seed = int.from_bytes(hashlib.blake2b(str((seed, len(out))).encode()).digest(), "big")
    return "".join(out)


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value; each attempt is another one. Names come without their last letters, which go by gender."""
    if kind == "ip":
        n, net = int(ipaddress.ip_address(canon)), _network(int(ipaddress.ip_address(canon)))
        if net:
            return str(ipaddress.ip_address(net[0] + moved(n - net[0], net[1], key, attempt, "ip", net[0])))
        while True:
            n = moved(n, 1 << 32, key, attempt, "ip")
            if _network(n) is None:
                return str(ipaddress.ip_address(n))
    if kind == "ssn":
        return _digits(canon, key, attempt, "ssn")
    if kind == "card":
        middle = _digits(canon[1:-1], key, attempt, "card", canon[0])
        return canon[0] + middle + str((_luhn(canon[0] + middle) + int(canon[-1]) - _luhn(canon[:-1])) % 10)
    if kind == "phone":
        return _digits(canon, key, attempt, "phone", alike=_dialled)
    if kind == "iban":
        country, rest = canon[:2], canon[4:]
        own = "".join(c for c in rest if c.isdigit())
        new = iter(_digits(own, key, attempt, "iban", country))
        rest = "".join(next(new) if c.isdigit() else c for c in rest)
        return country + _iban_check(country, rest) + rest
    seed = _hash(key, kind, canon, attempt)
    if kind == "email":
        local, _, domain = canon.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local + 'x' * attempt, seed)}@{_letters(host, _hash(key, 'domain', domain))}.{top}"
    if kind == "secret":
        head = next((p for p in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-") if canon.startswith(p)), "")
        return head + _letters(canon[len(head) :] + "x" * max(0, attempt - 3), seed)
    own, out = SYLLABLES[script_of(canon)], ""  # given or surname
    for _ in range((2 if kind == "given" else 3) + attempt):
        seed, k = divmod(seed, len(own))
        out += own[k]
    return out


def _shape(new: str, old: str) -> str:
    """The surrogate's alphanumerics in the separators of the original."""
    source = iter(new)
    return "".join(next(source) if c.isalnum() else c for c in old)


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.capitalize() if old[0].isupper() else new


def _phone(value: str) -> str | None:
    """The national number of a written phone number, without country code and trunk zeros; null for too short or long ones."""
    digits = "".join(c for c in value if c.isdigit())
    if not 8 <= len(digits) <= 15:
        return None
    if value[0] == "+":
        head = re.match(r"\+(\d{1,3})[ .(-]", value)
        digits = digits[len(head[1] if head else country_code(digits)) :]
    elif len(digits) == 11 and digits[0] == "1":
        digits = digits[1:]
    return digits.lstrip("0") or None


def entities(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical value, gender) of what is found, in order, without overlaps; gender of names only."""
    found: list[tuple[int, int, str, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower(), "") for m in _EMAIL.finditer(text)]
    found += [(m.start(1), m.end(1), "secret", m[1], "") for m in _QUOTED.finditer(text)] if '"' in text or "'" in text else []
    if any(d in text for d in "0123456789"):
        for m in _WITH_DIGITS.finditer(text):
            kind, value = m.lastgroup, m[0]
            canon: str | None = value
            if kind in ("ssn", "card"):
                canon = "".join(c for c in value if c.isdigit())
            elif kind == "phone":
                canon = _phone(value)
            elif kind == "iban":
                canon = value.replace(" ", "")
                if _iban_check(canon[:2], canon[4:]) != canon[2:4]:
                    continue
            if canon is not None:
                found.append((m.start(), m.end(), kind, canon, ""))
    names: dict[str, tuple[str, str, str]] = {}  # word in lower case -> kind, canonical value, gender
    if any(t in text for t in _GENDER):
        for m in _NAME.finditer(text):
            words = [m[k] for k in (2, 3) if m[k] and m[k][0].isupper()]
            if not m[2][0].isupper():
                continue
            gender = _GENDER[m[1]]
            root, told = surname_form(words[-1].lower())
            gender = told if gender == "n" else gender
            for word in words[:-1]:
                for piece in word.lower().split("-"):
                    names.setdefault(piece, ("given", piece, gender))
            for piece in words[-1].lower().split("-"):
                root, told = surname_form(piece)
                names.setdefault(piece, ("surname", root, told if told != "n" else gender))
    if names:
        mention = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", re.I)
        found += [(m.start(), m.end(), *names[m[0].lower()]) for m in mention.finditer(text) if m[0][0].isupper() and m[0].lower() in names]
    bare = {x[3] for x in found if x[2] == "phone"}
    if bare:
        found += [(m.start(), m.end(), "phone", c, "") for m in re.finditer(r"(?<![\w+])\d{8,15}(?!\w)", text) if (c := _phone(m[0])) in bare]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def written(kind: str, gender: str, old: str, new: str) -> str:
    """A canonical surrogate in the original's format, a name with the ending of its gender."""
    if kind in ("ssn", "card", "iban"):
        return _shape(new, old)
    if kind == "phone":
        # the last digits are the national number; a country code and trunk zeros before it stay
        digits = "".join(c for c in old if c.isdigit())
        return _shape(digits[: len(digits) - len(new)] + new, old)
    if kind in ("given", "surname"):
        return _cased(new + (ENDINGS if kind == "given" else SURNAMES)[script_of(old)][gender], old)
    return new


def replaced(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for start, end, kind, canon, gender in found:
        out += [text[at:start], written(kind, gender, text[start:end], surrogate(key, kind, canon, attempts.get((kind, canon), 0)))]
        at = end
    return "".join([*out, text[at:]]), [k for _, _, k, _, _ in found]


def _stem(word: str) -> str:
    """What a name's surrogate is compared by: the root of a surname."""
    return surname_form(word)[0]


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind, canon of all entities."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({(k, c) for x in texts(batch.column(0)) for _, _, k, c, _ in entities(x.decode("utf-8", "replace"))})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.string()), pa.array([c for _, c in got], pa.string())], names=["kind", "canon"])

    return docs.filter("text is not null").select("text").transform(in_arrow, emit, "kind string, canon string").distinct()


def retried(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate is another's surrogate or another's value.

    Where over two fifths of all values of a kind and format are in the documents (the addresses of a private network
    may all be), all of these take the attempt ALONE: distinct by construction, none its own value, but some the value
    of another entity, which can't be helped there. Elsewhere a fifth of all values at least are
    free to the last entity of each round, so that rounds end; there are as many as it takes.
    """

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for k, c, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x = surrogate(key, k, c, n)
                new.append(_stem(x + SURNAMES[script_of(c)]["m"]) if k == "surname" else x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canon", "attempt", "new"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [space(k, c) or (None, 0) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([min(n, 1 << 62) for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "canon", "space", "room"])

    every = checkpoint(distinct_entities(docs).transform(in_arrow, place, "kind string, canon string, space string, room long"))
    full = every.filter("space is not null").groupBy("kind", "space").agg(F.count("*").alias("n"), F.max("room").alias("room")).filter("n > 0.4 * room").select("kind", "space")
    crowded = checkpoint(every.join(full, ["kind", "space"], "left_semi").select("kind", "canon", F.lit(ALONE).alias("attempt")))
    own = checkpoint(every.join(full, ["kind", "space"], "left_anti").select("kind", "canon", F.lit(0).alias("attempt")))
    values = own.select("kind", F.col("canon").alias("new"))
    while True:
        given = checkpoint(own.transform(in_arrow, give, "kind string, canon string, attempt int, new string"))
        owner = given.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("n")).filter("n > 1")
        taken = given.join(owner, ["kind", "new"]).filter(F.struct("attempt", "canon") != F.col("owner")).select("kind", "canon")
        taken = checkpoint(taken.unionByName(given.join(values, ["kind", "new"], "left_semi").select("kind", "canon")).distinct())
        if taken.isEmpty():
            return own.filter("attempt > 0").unionByName(crowded)
        own = own.join(taken.withColumn("again", F.lit(1)), ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        own = checkpoint(own)


def pseudonymise(docs: DataFrame, key: bytes, most: int = 200_000) -> DataFrame:
    """Rows of ``docs``, all columns, with surrogates in text; plus n_entities and entities (kind=count, sorted, comma-joined).

    key: a secret; who knows it can undo the permutations. The same value gets the same surrogate everywhere, different
    values different ones, none of them the value of another entity. Null texts stay null, with no entities; texts of
    any length are read whole; where two kinds of entity overlap the one that begins first counts, of those the longer;
    repeated rows come out alike; an empty table gives an empty result. Retried entities are broadcast up to ``most``;
    beyond that they are joined to the documents that hold them. Columns n_entities and entities are replaced; columns
    of other names stay, whatever they are called.
    """
    again = checkpoint(retried(docs, key))
    docs = without(docs, "n_entities", "entities")
    at, width = docs.columns.index("text"), len(docs.columns)
    names = [*docs.columns, "n_entities", "entities"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entities", T.StringType())])
    few = again.limit(most + 1).collect()
    fixed = {(r["kind"], r["canon"]): r["attempt"] for r in few} if len(few) <= most else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            own = [{(x["kind"], x["canon"]): x["attempt"] for x in held or ()} for held in batch.column(width).to_pylist()] if fixed is None else None
            new, n, kinds = [], [], []
            for i, (text, ok) in enumerate(zip(texts(column), column.is_valid().to_pylist(), strict=True)):
                body, found = replaced(text.decode("utf-8", "replace"), key, fixed if own is None else own[i]) if ok else (None, [])
                new.append(body)
                n.append(len(found))
                kinds.append(",".join(f"{k}={v}" for k, v in sorted(Counter(found).items())))
            columns = [pa.array(new, column.type) if i == at else batch.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=names)

    if fixed is not None:
        return docs.transform(in_arrow, apply, schema)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r, k, c) for r, x in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for k, c in {(k, c) for _, _, k, c, _ in entities(x.decode("utf-8", "replace"))}]
            cols = list(zip(*got, strict=True)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["key", "kind", "canon"])

    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), row_key(docs).alias("key"))
    held = own.filter("doc.text is not null").select("key", "doc.text").transform(in_arrow, occurrences, "key long, kind string, canon string").distinct().join(again, ["kind", "canon"])
    held = held.groupBy("key").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("held"))  # as many as a text has entities
    return own.join(held, "key", "left").select("doc.*", F.col("held").alias(*fresh(docs, "held"))).transform(in_arrow, apply, schema)
