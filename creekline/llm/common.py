"""What several operators share: bounded Arrow batches, words, and a worker's tokenizer."""

from __future__ import annotations

import atexit
import functools
import json
import os
import pathlib
import re
import shutil
import tempfile
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Sequence

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows per Arrow batch. A batch of whole texts must fit a Python worker's memory.
BATCH_ROWS = 512

#: Bytes that part words: space and tab to carriage return. ``bytes.split()`` uses the same.
WHITE = "\x20\x09-\x0D"


def prepare_workers(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch and give the executors this package.

    A smaller number of rows that the user has set stays. The package goes out once per application, as
    ``--py-files`` would send it: through Spark, not through a folder.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    _send_package(spark.sparkContext.applicationId)


@functools.cache
def _send_package(_application: str) -> None:
    package = pathlib.Path(__file__).resolve().parents[1]
    # Executors fetch the file from the driver when they first need it, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="creekline-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for path in sorted(package.rglob("*.py")):
            file.write(path, path.relative_to(package.parent))
    SparkContext.getOrCreate().addPyFile(archive)


def shielded(df: DataFrame, work: Callable[[DataFrame, dict[str, str]], DataFrame]) -> DataFrame:
    """``work(df, names)`` while every column has a name that no operator uses, so none can clash.

    ``names`` gives the present name of a column; the result has the columns of ``df``, whose names are put back.
    """
    renamed = df.toDF(*[f"given_{i}" for i in range(len(df.columns))])
    return work(renamed, dict(zip(df.columns, renamed.columns, strict=True))).toDF(*df.columns)


def plain(value: str | None) -> str:
    """A text as given, null as the empty text."""
    return value if isinstance(value, str) else ""


#: What the Unicode property White_Space holds.
WHITE_SIGNS = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


class _Cache(dict):
    """Values by key, made on the first request. When half of ``limit`` is full these values become the older half and
    replace the one before, so what is asked for again stays; ``kept`` entries always do."""

    def __init__(self, fill: Callable, limit: int, kept: dict | None = None):
        super().__init__(kept or {})
        self.fill, self.kept, self.older = fill, kept or {}, {}
        self.limit = limit // 2 + len(self)

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
            self.update(self.kept)
        if len(key) <= 64:
            self[key] = value
        return value


class ChunkTokenizer:
    """Token ids of a ``tokenizers`` file whose pre-tokens never hold white space.

    Such a tokenizer drops white space, so the ids of a text are the ids of its chunks between
    white space, one after another, and a chunk's ids can be remembered. Chunks of Latin-1
    characters are cut with the tokenizer's own rule and given to its model; any other chunk
    and any that may hold a special string goes to the library whole.
    """

    #: The split rule that the fast way knows, as it stands in the tokenizer file (fixed value).
    RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        steps = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        names = [x["type"] for x in (kind.get("normalizer") or {}).get("normalizers", [])]
        self.isolates = (
            names == ["NFC", "Replace", "Lowercase"]
            and steps[0].get("pattern") == {"Regex": self.RULE}
            and steps[0].get("behavior") == "Removed"
        )
        latin = [chr(c) for c in range(256)]
        letters = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == "N")
        self.rule = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+"
        )
        # The same rule where only ASCII can occur, which is searched faster.
        self.ascii_rule = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.to_bytes = self._byte_alphabet()
        self.pieces = _Cache(self._piece, 200_000)

    @staticmethod
    def _byte_alphabet() -> dict[int, str]:
        """Latin-1 characters as the byte-level alphabet writes their UTF-8 bytes."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(256)}

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(token.id for token in self.model.tokenize(piece.translate(self.to_bytes)))

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_chunk(self, chunk: str) -> Sequence[int]:
        if "<|" in chunk or not is_latin(chunk):
            return self.encode_whole(chunk)
        chunk = chunk.lower()
        # Letters alone, and letters with one sign after them, need no search.
        if chunk.isalpha():
            return self.pieces[chunk]
        word, sign = chunk[:-1], chunk[-1]
        if word.isalpha() and not sign.isalnum():
            return self.pieces[word] + self.pieces[sign]
        pieces = (self.ascii_rule if chunk.isascii() else self.rule).findall(chunk)
        out: list[int] = []
        for piece in pieces:
            out += self.pieces[piece]
        return out

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, in lower case where that changes no id."""
        if not self.isolates:
            return [text] if text else []
        if "<|" not in text and is_latin(text):
            text = text.lower()
        for sign in "\x1c\x1d\x1e\x1f":  # white space to Python, not to the tokenizer
            if sign in text:
                return [x for x in re.split(WHITE_SIGNS, text) if x]
        return text.split()


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """One tokenizer per Python worker and file."""
    return ChunkTokenizer(path)


def read_columns(spark: SparkSession, sf_dir: str, table: str, columns: Iterable[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
