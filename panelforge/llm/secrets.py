"""Secret scans: fixed patterns, and strings in sensitive places that a primed compressor can't shorten.

The patterns give spans of the kinds assign, access and hex.  Every value that they find, and every run of token
characters that stands after a sensitive word, is a candidate; its novelty is the number of bytes that it adds to the
zstandard size of its surroundings, with a dictionary of common identifiers and of the text around it.  Words, names
and repeated strings add few bytes, keys and tokens about as many as random strings of their alphabet and length; of
the candidates beyond the patterns the latter are spans of the kind novel.
"""

from __future__ import annotations

import functools
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import small_batches
from ._text import filled, numbered, pieces_of, tidied

KINDS = ("assign", "access", "hex", "novel")
#: Fixed patterns; letters of the first words are in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: What stands before a candidate, at most REACH characters earlier (a PEM head: up to the next head or foot).
SENSITIVE = re.compile(r"(?:(?P<pem>-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)|passphrase|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|authorization|bearer|signature|session[_-]?id|cookie)", re.IGNORECASE | re.ASCII)
EDGE = re.compile(r"-----(?:BEGIN|END)")
REACH = 40
#: Runs of token characters that are measured, and the least length of a novel one: of any kind, or of letters with digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
LEAST, LEAST_NOVEL, LEAST_MIXED = 8, 16, 10
#: Characters on either side that prime the compressor; the share of a random string's added bytes that makes one novel.
AROUND, NOVEL = 1024, 0.85
#: Random strings that are measured for an alphabet and a length, and the greatest length.
DRAWS, LONGEST = 8, 4096
_CLASSES = (string.digits, "abcdef", "ABCDEF", string.ascii_lowercase, string.ascii_uppercase, "+/_=-")
#: Fixed list: identifiers and words of code that aren't secrets.
_WORDS = (
    "access_key access_token account admin api_key apikey args async auth authorization await base64 bearer body "
    "boolean cache client_id client_secret config connection const content-type context cookie credential data "
    "database def default delete description email endpoint env environment error export false filename float "
    "function getenv headers host http https import int integer interface json key length localhost message method "
    "name new none null object options os.environ params parse password path port private private_key public "
    "refresh_token region request response return schema secret secret_key select self server session session_id "
    "signature static status string struct table timeout timestamp token true type undefined update url user "
    "username uuid value var version void www xml yaml abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 example placeholder your_token_here your_api_key changeme bean builder change check class client "
    "code config configuration constant controller copy count create current default_value directory document domain "
    "entity event factory field file first format from generator group handler hash identifier index input instance "
    "invalid item last level library link list local log long manager map module my_own next node number output "
    "package page parent parser process project property provider query random read record request_id resource "
    "result role root scope search send service short size some source start stop store stream system tag target "
    "task template test text that this time type unit valid value variable vector view window with word write"
)
IDENTIFIERS = " ".join((_WORDS.title(), _WORDS))
RUN_BYTES = 1 << 20


def novelty(text: str, start: int, end: int) -> float:
    """Bytes that text[start:end] adds, for each of its characters, to the compressed text before it, where the
    compressor knows the identifiers and the text on either side."""
    before, value, after = text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]
    primer = zstandard.ZstdCompressionDict("\n".join((IDENTIFIERS, after, before)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=19, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)
    near = before[-64:]
    added = len(pack.compress((near + value).encode())) - len(pack.compress(near.encode()))
    return added / max(1, len(value))


def alphabet(value: str) -> str:
    """The characters of the classes that ``value`` has characters of; letters up to f alone count as hexadecimal."""
    own, found = set(value), set()
    for few, whole in ((1, 3), (2, 4)):
        letters = own & set(_CLASSES[whole])
        if letters:
            found |= set(_CLASSES[few if letters <= set(_CLASSES[few]) else whole])
    for k in (0, 5):
        if own & set(_CLASSES[k]):
            found |= set(_CLASSES[k])
    return "".join(sorted(found))


@functools.lru_cache(100_000)
def random_novelty(characters: str, length: int) -> float:
    """The mean novelty of random strings of these characters and this length (beyond 64 the multiple of 32 below, beyond 1,024 the power of two)."""
    if length > 64:
        length = length // 32 * 32 if length <= 1024 else min(LONGEST, 1 << (length.bit_length() - 1))
    rng = random.Random(f"{characters}:{length}")
    return max(1 / length, sum(novelty(" " + "".join(rng.choices(characters, k=length)), 1, length + 1) for _ in range(DRAWS)) / DRAWS)


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start and end of what the fixed patterns match, and where its value starts."""
    found = [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]


def candidates(text: str, base: list[tuple[str, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of token characters in reach of a sensitive word that touch no span of ``base``, each as the ways to read
    it: what stands after the first sensitive word, and, if some are inside the run, after the last.

    Runs, words and PEM edges are each found in one pass and matched by their places, so the work grows with the text
    however often a word repeats."""
    words = [(m.end(), bool(m["pem"])) for m in SENSITIVE.finditer(text)]
    if not words:
        return []
    runs = [m.span() for m in CANDIDATE.finditer(text)]
    starts, ends = [a for a, _ in runs], [b for _, b in runs]
    edges = [m.start() for m in EDGE.finditer(text)] if any(pem for _, pem in words) else []
    spans = sorted((a, b) for _, a, b, _ in base)
    reach, top = [], 0  # the greatest end of the spans up to each, as they may overlap
    for _, b in spans:
        top = max(top, b)
        reach.append(top)
    opened = [a for a, _ in spans]
    found: dict[int, list[tuple[int, int]]] = {}
    for at, pem in words:
        stop = at + REACH
        if pem and (k := bisect_left(edges, at)) < len(edges):
            stop = max(stop, edges[k])
        for k in range(bisect_right(ends, at), bisect_right(starts, stop)):
            a, b = max(starts[k], at), ends[k]
            n = bisect_left(opened, b)
            if b - a >= LEAST and not (n and reach[n - 1] > a):
                ways = found.setdefault(k, [])
                if (a, b) not in ways:
                    ways[1:] = [(a, b)]
    return [found[k] for k in sorted(found)]


def share(text: str, start: int, end: int) -> tuple[float, float]:
    """Novelty of text[start:end], and its share of that of random strings of the same alphabet and length."""
    own = novelty(text, start, end)
    return own, own / random_novelty(alphabet(text[start:end]), end - start)


def _telling(value: str) -> bool:
    """Whether a value is long enough to be told from a word."""
    return len(value) >= LEAST_NOVEL or len(value) >= LEAST_MIXED and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def scan(text: str) -> list[tuple[str, int, int, float, float]]:
    """The spans of a text and its other candidates: kind (null for a candidate that isn't novel), start and end in
    code points, novelty, and its share of random strings' novelty; by start, then kind."""
    base = base_spans(text)
    found = [(kind, a, b, *share(text, value, b)) for kind, a, b, value in base]
    for ways in candidates(text, base):
        measured = [(None, a, b, *share(text, a, b)) for a, b in ways]
        told = next(((*m[1:],) for m in measured if m[4] >= NOVEL and _telling(text[m[1] : m[2]])), None)
        found.append(("novel", *told) if told else measured[-1])
    return sorted(found, key=lambda x: (x[1], (*KINDS, None).index(x[0]), x[2]))


_FIELDS = ("kind", "start", "end", "novelty", "share")
SPANS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in zip(_FIELDS, (T.StringType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()), strict=True)]))
_ARROW = pa.list_(pa.struct(list(zip(_FIELDS, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "spans") -> DataFrame:
    """``keep`` (default: all columns) of every row with ``out``, what ``scan`` finds in the whole text: entries with a
    kind are spans, the others candidates that were measured and aren't novel.

    Null and empty texts have none.  Rows stand for themselves: repeated rows agree, an empty table gives an empty
    one, and there is no shuffle.  Time grows with the text, however long it is and however often a word repeats in
    it.  A column of ``df`` called ``out`` gives way.
    """
    small_batches(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    source, names, keep = numbered(df, keep, F.col(f"`{text}`").alias("__text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "__text__", RUN_BYTES):
                rows = [[dict(zip(_FIELDS, s, strict=True)) for s in scan(t)] for t in filled(part.column("__text__")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(rows, _ARROW)], [*keep, out])

    return source.mapInArrow(tidied(run), T.StructType([*[source.schema[c] for c in keep], T.StructField(out, SPANS)])).toDF(*names, out)


def as_string(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
