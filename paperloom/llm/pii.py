"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, URL schemes, digit pairs, signs before
digits and identifier cues. A deterministic parser grows each anchor to the left and right, finds the
boundaries and validates. Each parser reads a run of characters once, so the work is linear in the text,
also where a regular expression would rescan long runs.

Kinds: email, ip, card (Luhn) and phone have the boundaries of the expressions

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                      14 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 10 to 15 digits

each taken leftmost and without overlaps in its kind; failing matches go. The method adds five kinds:

* ``iban``: in the rest of a line after the cue "iban", each run of that shape that passes mod 97;
* ``ssn``: in the rest of a line after "ssn" or "social security", each AAA-GG-SSSS that isn't impossible;
* ``login``: the user:password part of a URL;
* ``account``: 6 to 20 digits after "account" or a like cue, with only words such as "no" or "number" between;
* ``secret``: the value after a name such as token, api_key or password and a sign "=" or ":", in quotes or bare.
  Values of tokens and keys have 16 characters or more, letters and digits both or hexadecimal digits only;
  those of passwords 6 or more, and where bare a digit or sign among them. Also keys that their own fixed
  beginning shows, and PEM blocks of private keys.

Cues count in any case, names and values of any length are read to their end, and a value may stand on the line after its sign
(a password's with a digit then); for "iban" and "ssn" the next line counts where nothing else follows on the cue's own.

Offsets are code points, end exclusive. A null text is an empty one and has no spans; texts of any length are
read whole, in time that grows with their length; repeated rows each give a row; empty tables give no rows;
further columns are ignored or, in masking, kept.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.llm.common import any_names, decoded, map_batches, map_rows, place_of, quoted, text_bytes

KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "login", "account", "secret")
ORDER = {k: i for i, k in enumerate((*KINDS, *ADDED))}
DIGITS = frozenset("0123456789")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
BLANK, SIGNS, BEFORE_NUMBER = frozenset(" \t"), frozenset("=:>"), frozenset(" \t.:#=°º-_")
LABEL = DIGITS | LETTERS | {"-"}
LOCAL = DIGITS | LETTERS | set("._%+-")
PHONE = DIGITS | set(" ().-")
#: Cues of identifiers and of secrets, in lower case.
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn"} | dict.fromkeys(("account", "acct", "konto", "cuenta", "compte"), "account")
TOKEN_CUES = ("token", "secret", "api_key", "api-key", "api key", "apikey", "access_key", "access key", "private_key", "auth_key", "authorization", "bearer", "credential")
PASSWORD_CUES = ("password", "passwd", "passphrase", "pwd")
#: Beginnings of well-known keys, the characters that follow, and how many at least.
KEY_STARTS = {"AKIA": 16, "ASIA": 16, "ghp_": 36, "gho_": 36, "ghs_": 36, "ghu_": 36, "github_pat_": 36, "xoxb-": 20, "xoxp-": 20, "sk_live_": 20, "rk_live_": 20, "AIza": 35}
PEM = "-----BEGIN "
#: What may stand between a cue of an account and its number.
BETWEEN = frozenset(("no", "nr", "num", "number", "nummer", "numero", "id", "is", "n"))
TOKEN_LENGTH, PASSWORD_LENGTH = 16, 6
NAME = DIGITS | LETTERS | set("_-")
TOKEN = NAME | set("+/=.~")
HEX = frozenset("0123456789abcdefABCDEF")
#: Characters besides white space at which a bare value ends.
CLOSERS = frozenset("\"'`,;<>()[]{}&")
QUOTES = frozenset("\"'`")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case, each with the kind of parser it starts and the place of its main character."""
    out, anchors = ahocorasick.Automaton(), {}
    put = lambda text, kind, back: anchors.setdefault(text, (kind, back))
    put("@", "email", 0)
    for a in "0123456789":
        put(f"+{a}", "phone", 1)
        for b in "0123456789":
            put(f"{a}.{b}", "ip", 2)
            put(f"{a}{b}", "card", 1)
            put(f"{a} {b}", "card", 2)
            put(f"{a}-{b}", "card", 2)
    for s in SCHEMES:
        put(s, "login", -1)
    for cue, kind in (CUES | dict.fromkeys(TOKEN_CUES, "token") | dict.fromkeys(PASSWORD_CUES, "password")).items():
        put(cue, kind, -1)
    for start in KEY_STARTS:
        put(start.lower(), f"key {start}", len(start) - 1)
    put(PEM.lower(), "pem", len(PEM) - 1)
    for text, value in anchors.items():
        out.add_word(text, value)
    out.make_automaton()
    return out


def run_end(text: str, at: int, allowed: frozenset | set) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, least: int, allowed: frozenset | set) -> int:
    """The start of the run of allowed characters that ends before at, least at the lowest."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    start = run_start(text, at, least, LOCAL)
    if start == at:
        return None
    end = run_end(text, at + 1, LABEL)
    if end == at + 1:
        return None
    dots = 0
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = run_end(text, end + 1, LABEL)
        dots += 1
    return (start, end) if dots else None


def ip_at(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    """at: the first digit before a dot. The span that the expression takes, and whether its parts are in range."""
    start = run_start(text, at, least, DIGITS)
    ends, end = [], start
    for k in range(4):
        stop = run_end(text, end, DIGITS)
        if stop == end:
            return None
        ends.append((end, stop))
        if k < 3:
            if stop >= len(text) or text[stop] != ".":
                return None
            end = stop + 1
    return start, ends[-1][1], all(stop - begin <= 3 + leading_zeros(text, begin, stop) and int(text[max(begin, stop - 3) : stop]) <= 255 for begin, stop in ends)


def leading_zeros(text: str, begin: int, stop: int) -> int:
    n = 0
    while begin + n < stop and text[begin + n] == "0":
        n += 1
    return n


def card_at(text: str, at: int, least: int) -> tuple[int, int, str]:
    """The maximal run of digits with at most one space or hyphen between two, from the leftmost digit on."""
    start = at
    while True:
        if start > least and text[start - 1] in DIGITS:
            start -= 1
        elif start > least + 1 and text[start - 1] in " -" and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    end, n = at + 1, len(text)
    while True:
        if end < n and text[end] in DIGITS:
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end, text[start:end].replace(" ", "").replace("-", "")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, int, int] | None:
    """Start, end and number of digits. The expression's last character is the run's last digit, and one more character lies between."""
    end = run_end(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end, sum(c in DIGITS for c in text[plus:end])) if end >= plus + 4 else None


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """Two capitals, two digits and 11 to 30 capitals or digits, single spaces between, mod 97 = 1."""
    found, end, taken = [], at, []
    while end < len(text) and len(found) < 34:
        c = text[end]
        if "A" <= c <= "Z" or c in DIGITS:
            found.append(c)
            end += 1
            taken.append(end)
        elif c == " " and end + 1 < len(text) and (text[end + 1] in DIGITS or "A" <= text[end + 1] <= "Z"):
            end += 1
        else:
            break
    for n in range(len(found), 14, -1):  # a word in capitals may follow the number
        code = "".join(found[4:n] + found[:4])
        if int("".join(str(int(c, 36)) for c in code)) % 97 == 1:
            return at, taken[n - 1]
    return None


def iban_starts(text: str, at: int, stop: int) -> Iterator[int]:
    for k in range(at, stop - 14):
        if text[k] in CAPITALS and text[k + 1] in CAPITALS and text[k + 2] in DIGITS and text[k + 3] in DIGITS and not (k and text[k - 1] in LABEL):
            yield k


def ssn_at(text: str, at: int) -> tuple[int, int] | None:
    """AAA-GG-SSSS, not in the impossible ranges, no digit beside it."""
    part = text[at : at + 11]
    if len(part) < 11 or not part.isascii() or part[3] not in "- " or part[6] != part[3]:
        return None
    area, group, serial = part[:3], part[4:6], part[7:]
    if not (area + group + serial).isdigit() or area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" or text[at + 11 : at + 12] in DIGITS:
        return None
    return at, at + 11


def ssn_starts(text: str, at: int, stop: int) -> Iterator[int]:
    for k in range(at, stop - 10):
        if text[k] in DIGITS and not (k and text[k - 1] in DIGITS):
            yield k


def line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def rest_of_line(kind: str, text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """All values of a kind from a cue to the line's end, or the next line's where only signs follow, and where that is."""
    starts, parser = (iban_starts, iban_at) if kind == "iban" else (ssn_starts, ssn_at)
    out, stop = [], line_end(text, at)
    if not text[at:stop].strip(" \t\r.:#="):
        stop = line_end(text, min(stop + 1, len(text)))
    for k in starts(text, at, stop):
        if (not out or k >= out[-1][1]) and (found := parser(text, k)):
            out.append(found)
    return out, stop


def next_line(text: str, at: int) -> int:
    """Past a line break at this place and the blanks after it."""
    stop = at + (text[at : at + 1] == "\r")
    return run_end(text, stop + 1, BLANK) if text[stop : stop + 1] == "\n" else at


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """6 to 20 digits, single spaces, dots or hyphens between, after signs and up to four words of BETWEEN."""
    for _ in range(5):
        at = run_end(text, at, BEFORE_NUMBER)
        end = run_end(text, at, LETTERS)
        if end == at:
            break
        if text[at:end].lower() not in BETWEEN:
            return None
        at = end
    if text[at - 1] in ":#=":
        at = next_line(text, at)
    end, digits = at, 0
    while end < len(text) and digits <= 20 and (text[end] in DIGITS or digits and text[end] in " .-" and text[end + 1 : end + 2] in DIGITS and text[end + 1 : end + 2]):
        digits += text[end] in DIGITS
        end += 1
    return (at, end) if 6 <= digits <= 20 and text[end : end + 1] not in LETTERS else None


class Runs:
    """The run of name characters and the bare value that were read last, so that cues within one don't read it again."""

    def __init__(self, text: str):
        self.text = text
        self.name = self.bare = (0, 0)
        # where the bare value last has a digit, a letter, and characters that a token, a hexadecimal number or a word has not
        self.last = dict.fromkeys(("digit", "letter", "no token", "no hex", "no alpha"), -1)

    def name_end(self, at: int) -> int:
        if not self.name[0] <= at < self.name[1]:
            self.name = at, run_end(self.text, at, NAME)
        return self.name[1]

    def bare_end(self, at: int) -> int:
        """The end of the bare value that begins at this place; last is set for it."""
        text = self.text
        if not self.bare[0] <= at < self.bare[1]:
            end = at
            while end < len(text) and not text[end].isspace() and text[end] not in CLOSERS:
                end += 1
            self.bare = at, end
            while end > at and text[end - 1] in ".:":
                end -= 1
            self.end = end
            of = {"digit": DIGITS.__contains__, "letter": LETTERS.__contains__, "no token": lambda c: c not in TOKEN, "no hex": lambda c: c not in HEX, "no alpha": lambda c: not c.isalpha()}
            self.last = {name: next((k for k in range(end - 1, at - 1, -1) if test(text[k])), -1) for name, test in of.items()}
        return max(at, self.end)


def secret_after(text: str, at: int, kind: str, bearer: bool, runs: Runs) -> tuple[int, int] | None:
    """The value after a name, which may go on (token_id), and a sign; after "bearer" a space is enough."""
    at = runs.name_end(at)
    at += text[at : at + 1] in QUOTES and at < len(text)
    blank = at
    at = run_end(text, at, BLANK)
    sign = at
    at = run_end(text, at, SIGNS)
    if at == sign and not (bearer and sign > blank):
        return None
    line = at = run_end(text, at, BLANK)
    at = next_line(text, at)
    below = at > line
    if text[at : at + 7].lower() == "bearer ":
        at += 7
    least = PASSWORD_LENGTH if kind == "password" else TOKEN_LENGTH
    quote = text[at : at + 1] if text[at : at + 1] in QUOTES and at < len(text) else ""
    if quote:
        at += 1
        end = at
        while end < len(text) and text[end] != quote and text[end] != "\n":
            end += 1
        seen = set(text[at:end])
        if text[end : end + 1] != quote or end - at < least:
            return None
        if kind == "password":
            good = not any(map(str.isspace, seen)) and (not below or bool(seen & DIGITS))
        else:
            good = seen <= TOKEN and bool(seen & DIGITS) and (bool(seen & LETTERS) or seen <= HEX)
        return (at, end) if good else None
    end = runs.bare_end(at)
    if end - at < least:
        return None
    has = lambda what: runs.last[what] >= at
    if kind == "password":
        good = has("no alpha") and (not below or has("digit"))
    else:
        good = not has("no token") and has("digit") and (has("letter") or not has("no hex"))
    return (at, end) if good else None


def pem_at(text: str, at: int, foot: int) -> tuple[tuple[int, int] | None, int]:
    """A block from "-----BEGIN ... PRIVATE KEY-----" to the next end line, which must have its label; and where that line begins.

    foot: the end line found for an earlier block, read again where it still lies ahead; the text's length where there is none.
    """
    head = text.find("-----", at + len(PEM))
    label = text[at + len(PEM) : head] if head >= 0 else ""
    if not label.endswith("PRIVATE KEY") or "\n" in label:
        return None, foot
    if foot < head:
        foot = text.find("-----END ", head)
        foot = len(text) if foot < 0 else foot
    last = f"-----END {label}-----"
    return ((at, foot + len(last)) if text.startswith(last, foot) else None), foot


def login_after(text: str, at: int) -> tuple[int, int] | None:
    """user:password before the at-sign of a URL's host."""
    end, colon = at, False
    while end < len(text) and text[end] not in "/?#@" and not text[end].isspace():
        colon |= text[end] == ":"
        end += 1
    return (at, end) if colon and end > at and text[end : end + 1] == "@" else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """All spans of a whole text, by start, then kind as listed."""
    out: list[tuple[int, int, str]] = []
    # where each kind's last match ends, whether it passed or not: the next begins there at the earliest
    after, foot, runs = dict.fromkeys(ORDER, 0), -1, Runs(text)
    # of all characters only U+0130 has a lower form of another length
    for end, (kind, back) in automaton().iter(text.replace("İ", "i").lower()):
        at = end - back
        if kind == "email":
            if at >= after["email"] and (found := email_at(text, at, after["email"])):
                out.append((*found, "email"))
                after["email"] = found[1]
        elif kind == "card":
            if at >= after["card"]:
                start, stop, digits = card_at(text, at, after["card"])
                after["card"] = stop
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((start, stop, "card"))
        elif kind == "ip":
            if at >= after["ip"] and (found := ip_at(text, at, after["ip"])):
                after["ip"] = found[1]
                if found[2]:
                    out.append((found[0], found[1], "ip"))
        elif kind == "phone":
            if at >= after["phone"] and (found := phone_at(text, at)):
                after["phone"] = found[1]
                if 10 <= found[2] <= 15:
                    out.append((found[0], found[1], "phone"))
        elif kind in ("iban", "ssn"):
            if end + 1 >= after[kind]:  # else that line was read for an earlier cue
                every, after[kind] = rest_of_line(kind, text, end + 1)
                out += [(*x, kind) for x in every]
        else:
            if kind == "login":
                found, label = login_after(text, end + 1), "login"
            elif kind == "account":
                found, label = account_after(text, end + 1), "account"
            elif kind == "pem":
                if not text.startswith(PEM, at):
                    continue
                (found, foot), label = pem_at(text, at, foot), "secret"
            elif kind.startswith("key "):
                if not text.startswith(kind[4:], at):
                    continue
                stop = end + 1 if at and text[at - 1] in NAME else run_end(text, end + 1, NAME)  # one reading of a run
                found, label = ((at, stop) if stop - end - 1 >= KEY_STARTS[kind[4:]] else None), "secret"
            else:
                if end < after["secret"]:  # within a value
                    continue
                found, label = secret_after(text, end + 1, kind, text[end - 5 : end + 1].lower() == "bearer", runs), "secret"
            if found and found[0] >= after[label]:
                out.append((*found, label))
                after[label] = found[1]
    return sorted(out, key=lambda x: (x[0], ORDER[x[2]]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (all kinds) for each row of docs(doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find_spans(decoded(x)) for x in batch.column(1).to_pylist()]
        counts = [pa.array([sum(s[2] == k for s in x) for x in found], pa.int64()) for k in KINDS]
        base = [hashlib.sha256(joined([s for s in x if s[2] in KINDS]).encode()).hexdigest() for x in found]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(base, pa.string()), pa.array([joined(x) for x in found], pa.string()), pa.array([len(x) for x in found], pa.int64())], names=names)

    return map_batches(docs.select("doc_id", text_bytes()), run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")


def masked(text: str) -> str:
    """The text with each span replaced by its kind, as [EMAIL]; of overlapping spans the earliest names the whole."""
    parts, at = [], 0
    spans = find_spans(text)
    k = 0
    while k < len(spans):
        start, end, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < end:
            end = max(end, spans[k][1])
            k += 1
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]]) if parts else text


@any_names("text", "n_chars")
def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with text masked and, where there is such an integer column, n_chars the new length.

    A null text stays null; malformed UTF-8 becomes U+FFFD. Columns keep their names, whatever these are.
    """
    names = docs.columns
    text = place_of(docs, "text")
    size = next((i for i, c in enumerate(names) if c.lower() == "n_chars"), None)
    # Python gets bytes, as malformed text would stop a batch
    raw = docs.select(*[text_bytes(quoted(c)).alias(c) if i == text else F.col(quoted(c)) for i, c in enumerate(names)])

    def run(batches):
        for batch in batches:
            texts = [None if x is None else masked(decoded(x)) for x in batch.column(text).to_pylist()]
            columns = list(batch.columns)
            columns[text] = pa.array(texts, pa.string())
            if size is not None and pa.types.is_integer(columns[size].type):
                columns[size] = pa.array([old if x is None else len(x) for x, old in zip(texts, columns[size].to_pylist(), strict=True)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    schema = StructType([StructField(c, StringType()) if i == text else f for i, (c, f) in enumerate(zip(names, docs.schema.fields, strict=True))])
    return map_rows(raw, run, schema)
