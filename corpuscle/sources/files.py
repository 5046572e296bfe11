"""Raw corpora in, tables and records out."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zipfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: In this order an unknown file's encoding is tried.
ENCODINGS = ("utf-8", "cp1252", "latin-1")


def decode(raw: bytes) -> tuple[str, str]:
    """The text of ``raw`` and the encoding that read it."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads every byte")


def unzip_member(archive: str, member: str, folder: str) -> str:
    """Writes one named member of an archive into ``folder``; a KeyError if there is none."""
    with zipfile.ZipFile(archive) as z:
        target = Path(folder) / Path(member).name
        target.write_bytes(z.read(member))
    return str(target)


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def provenance(path: str, source: str) -> dict:
    return {"source": source, "file": os.path.basename(path), "bytes": os.path.getsize(path), "sha256": sha256_file(path), "read_at": datetime.now(UTC).isoformat()}


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_number, label, text) of a file with a label, a tab and a text a line. Lines count from 1, blank ones too;
    only the first tab parts; a line without one is an error when it is read. Each file is read whole by one task,
    so that lines count from its beginning; give a folder of files for many tasks."""
    lines = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column("content").to_pylist():
                numbers, labels, texts = [], [], []
                for n, line in enumerate(decode(raw)[0].split("\n"), 1):
                    line = line.removesuffix("\r")
                    if not line:
                        continue
                    label, tab, text = line.partition("\t")
                    if not tab:
                        raise ValueError(f"line {n} has no tab")
                    numbers.append(n)
                    labels.append(label)
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(labels, pa.string()), pa.array(texts, pa.string())], ["row_number", "label", "text"])

    return lines.mapInArrow(parse, "row_number bigint, label string, text string")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header; NA and the like stay as they are, only an unquoted nothing is null."""
    return spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, nullValue="\x00", emptyValue="")


def write_csv(df: DataFrame, path: str) -> None:
    """Parts with a header each, quoted only where needed, quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(path: str) -> dict:
    """A record, or an empty one if there is no file."""
    return json.loads(Path(path).read_text("utf-8")) if os.path.exists(path) else {}


def write_text(path: str, text: str) -> bool:
    """Writes a small file in one step, by way of another in the same folder, and only if it changes; whether it
    did. Folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if target.exists() and target.read_text("utf-8") == text:
        return False
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, delete=False) as f:
        f.write(text)
    os.replace(f.name, target)
    return True


def write_json(path: str, record: object) -> bool:
    return write_text(path, json.dumps(record, indent=2, ensure_ascii=False) + "\n")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A report's table of a small result; more rows than ``limit`` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.length("value") >= 0).count()
