"""Secrets by dictionary-primed zstandard novelty.

Candidates are strings in a sensitive context: after a word as "password" or "token", or with the prefix of a known kind of
key. Each is compressed with a dictionary of common identifiers and of its whole text without the candidates; what the
candidate adds, between two words of the dictionary, is its marginal size. A string that adds little less than random ones of its
length and alphabet do is news to its surroundings and is reported, whatever its characters, if it adds enough bytes to be a key at all.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Callable
from functools import lru_cache, partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quarry.llm.shared import apart, find_in_texts

NOVELTY = 0.85  #: marginal bytes of a candidate for each that a random string of its length and alphabet has
LEAST = 6  #: marginal bytes of a secret

IDENTIFIERS = " ".join(
    """access_key access_token account activate address admin algorithm api_key apikey application argument array assert async attribute auth
    authenticate authentication authorization await base64 begin boolean bucket buffer build cache callback certificate changeme changeit char class client
    client_id client_secret code column command comment commit component config configuration connect connection const constructor container content context
    controller cookie count create credential credentials current database datetime debug decode default define delete dependency description deploy
    development dictionary directory disable document domain double email empty enable encode encoding encrypt endpoint entity enum environment error event
    example exception execute export extends extern factory false field file filter final finally float folder format forward function generate
    getenv getPassword getToken global group handle handler hash header helper hidden hostname http https identifier identity image implement import include index info
    init initialize input insert instance integer interface internal invalid iterator json keyword lambda language length library list load local localhost
    location logger login logout machine main manager mapping master matrix memory message metadata method middleware migration model module mutable name namespace native
    network node null number object option optional order output override package padding parameter params parent parse passphrase passwd password passwordHash passwordField
    path pattern payload permission persist placeholder plugin pointer policy port prefix primary private private_key process production profile project prompt properties property protected
    protocol provider public public_key query queue random range read record redirect reference refresh_token register release remote remove render repository request require reset
    resource response result return role route router runtime sample schema scope script search secret secret_key secretKey select sequence serial server service session
    settings setup shell signature size socket source standard static status storage stream string struct submit subject suffix super switch symbol sync system table target
    task template temporary test testing thread throw timeout timestamp token tokenizer tokenType tracking transaction transform true type undefined unique update upload username user_id
    user validate value variable vector verify version view virtual void volume warning website widget window worker workspace write xxxxxxxx XXXXXXXX yourPasswordHere your_api_key process.env. os.environ SECRET_KEY ACCESS_TOKEN API_TOKEN DB_PASSWORD
    abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000 aaaaaaaa ffffffff""".split()
)
CONTEXT = re.compile(r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credential|bearer|client[_-]?key)")
BEFORE = re.compile(r"""[A-Za-z_]{0,24}["']?(\s{0,3}(?:=>|:=|[:=]|\s)\s{0,3}(?:(?:[Bb]earer|[Bb]asic)\s{1,9})?["'`]?)(?=[^\s"'`,;<>(){}\[\]|])""")
_END = re.compile(r"""[\s"'`,;<>(){}\[\]|]|\Z""")
PREFIX = re.compile(r"(?<![A-Za-z0-9])(?:(AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_\-]{35}|sk-[A-Za-z0-9_\-]{20,}|(?<![_\-])eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{5,})(?![A-Za-z0-9])")
PEM = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
#: Every candidate's text has one of these when its case is folded.
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "akia", "asia", "gh", "xox", "aiza", "sk-", "eyj")


#: A candidate is compressed between these, which the dictionary has: a match in it costs what it costs in a long text.
_HEAD, _TAIL = IDENTIFIERS[1000:1032].encode(), IDENTIFIERS[2000:2032].encode()
_ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/=-_.")


def _measure(around: str) -> Callable[[bytes], int]:
    """Marginal compressed bytes against identifiers and the text around; the dictionary is digested once for all candidates of a text."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + around).encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=9)
    zip_ = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress
    plain = len(zip_(_HEAD + _TAIL))
    return lambda raw: len(zip_(_HEAD + raw + _TAIL)) - plain


_alone = lru_cache(maxsize=1)(lambda: _measure(""))


@lru_cache(maxsize=4096)
def _random_bytes(alphabet: str, n: int) -> float:
    """Marginal bytes of n random characters of an alphabet, the mean of three seeded strings: Huffman codes make them fewer than n."""
    rng = random.Random(n)
    return sum(_alone()("".join(rng.choices(alphabet, k=n)).encode()) for _ in range(3)) / 3


def novelty(candidate: str, measure: Callable[[bytes], int]) -> tuple[int, float]:
    """(marginal compressed bytes as measured, those for each that a random string adds)."""
    raw = candidate.encode("utf-8", "replace")
    added, own = measure(raw), set(candidate)
    alphabet = next((a for a in _ALPHABETS if own.issubset(a)), string.printable[:94])
    return added, added / max(1, min(len(raw), _random_bytes(alphabet, len(raw))))


def without(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text without the spans."""
    parts, at = [], 0
    for i, j, _ in spans:
        parts.append(text[at:i])
        at = j
    return "".join([*parts, text[at:]])


def _is_word(s: str) -> bool:
    """Whether s is as words of prose are: letters of one case, or capitalised, joined by hyphens at most."""
    return all(p.isalpha() and (p[1:] == p[1:].lower() or p.isupper()) for p in s.split("-"))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of strings in a sensitive context, longest first where two overlap.

    Of any length and any characters, each string once however many such words it has; only after white space alone, without a sign, a quote or "Bearer", a plain word is no value but the next of a sentence.
    """
    found, begun = [], None
    for m in PEM.finditer(text):
        if m.group(1) == "BEGIN":
            begun = m.end() if begun is None else begun
        elif begun is not None:
            found.append((begun, m.start(), "private key"))
            begun = None
    found += [(m.start(), m.end(), "known prefix") for m in PREFIX.finditer(text)]
    taken = 0  # a later candidate with the same end is a part of the one before
    for m in CONTEXT.finditer(text):
        if (v := BEFORE.match(text, m.end())) and v.end() >= taken:
            end = _END.search(text, v.end()).start()
            s = text[v.end() : end].rstrip(".!?%$#&*")
            if s and (not _is_word(s) or m.group().lower() == "bearer" or re.search(r"[:=\"'`]|[Bb]earer\s|[Bb]asic\s", v.group(1))):
                found.append((v.end(), v.end() + len(s), "assigned"))
                taken = end
    return apart(sorted(set(found), key=lambda f: (f[0] - f[1], f[0], f[2])))


def find_secrets(text: str | None, threshold: float = NOVELTY) -> list[tuple[int, int, str, int, float, str, str]]:
    """(start, end, kind, marginal bytes, novelty, masked string, SHA-256) of each secret in a whole text."""
    if not text:
        return []
    low = text.casefold()
    if not any(h in low for h in _HINTS):
        return []
    spans = candidates(text)
    if not spans:
        return []
    measure, out = _measure(without(text, spans)), []
    for i, j, kind in spans:
        s = text[i:j]
        added, share = novelty("".join(s.split()), measure)
        if s.startswith("eyJ"):  # what is secret of a JSON web token is its signature, whatever the claims repeat
            signed, own = novelty(s.rpartition(".")[2], measure)
            share = max(share, own if signed >= LEAST else 0.0)
        if share >= threshold and added >= LEAST:
            shown = min(4, len(s) // 4)
            out.append((i, j, kind, added, round(share, 6), s[:shown] + "*" * (min(len(s), 24) - shown), hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()))
    return out


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = NOVELTY) -> DataFrame:
    """(doc_id, start, end, kind, marginal_bytes, novelty, masked, sha256) of each secret; start and end count characters.

    Null and empty texts have none. Repeated rows are reported each, rows with a null id with a null id; ids keep their type. Texts of
    any length are read whole, and their cost grows with their length: of candidates that overlap the longest counts, of equals the first.
    An empty table gives an empty result. Extra columns are not read, whatever their names.
    """
    i64 = pa.int64(), "bigint"
    fields = [("start", *i64), ("end", *i64), ("kind", pa.string(), "string"), ("marginal_bytes", *i64), ("novelty", pa.float64(), "double"), ("masked", pa.string(), "string"), ("sha256", pa.string(), "string")]
    return find_in_texts(docs, id_col, text, lambda: partial(find_secrets, threshold=threshold), fields)
