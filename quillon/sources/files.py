"""Files as documents, and document tables as collections."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Mapping
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import basename
from ..functions.web import html_text
from .store import Store

WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORDS}t")) for p in root.iter(f"{WORDS}p"))


READERS: dict[str, Callable[[bytes], str]] = {
    "txt": lambda b: b.decode("utf-8"),
    "md": lambda b: b.decode("utf-8"),
    "html": lambda b: html_text(b.decode("utf-8", "replace")) or "",
    "docx": docx_text,
}


def guarded(convert: Callable[[bytes], str], fallback: Callable[[bytes], str] | None = None, timeout_s: float | None = None) -> Callable[[bytes], str]:
    """A reader that converts, and where that fails, gives no text or takes longer than timeout_s, falls back to another one."""

    def read(data: bytes) -> str:
        from concurrent.futures import ThreadPoolExecutor

        pool = ThreadPoolExecutor(1)
        try:
            if (text := pool.submit(convert, data).result(timeout_s)).strip() or fallback is None:
                return text
        except Exception:
            if fallback is None:
                raise
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
        return fallback(data)

    return read


def load(
    spark: SparkSession,
    path: str,
    pdf: Callable[[bytes], str] | None = None,
    recursive: bool = True,
    pdf_plain: Callable[[bytes], str] | None = None,
    pdf_timeout_s: float | None = 300,
) -> DataFrame:
    """(path, name, extension, text, error) of the files under a path, by extension. A file that can't be read, or has an
    extension without a reader, has an error and no text, and stops nothing. PDF needs a converter; where it fails or takes too long,
    pdf_plain reads the file's plain text."""
    readers = READERS | ({"pdf": guarded(pdf, pdf_plain, pdf_timeout_s)} if pdf else {"pdf": pdf_plain} if pdf_plain else {})

    def run(batches):
        for pdf_ in batches:
            texts, errors = [], []
            for ext, data in zip(pdf_["extension"], pdf_["content"]):
                text = err = None
                try:
                    if ext in readers:
                        text = readers[ext](bytes(data))
                    else:
                        err = f"unsupported extension: {ext}"
                except Exception as e:  # whatever a broken file makes a reader raise
                    err = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(err)
            yield pd.DataFrame({"path": pdf_["path"], "name": pdf_["name"], "extension": pdf_["extension"], "text": texts, "error": errors})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    named = files.select("path", basename(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "content")
    return named.mapInPandas(run, "path string, name string, extension string, text string, error string")


def prompts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Prompt texts by file stem, from any file system that Spark reads."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), "value").collect()
    return {r["path"].rsplit("/", 1)[-1].removesuffix(".txt"): r["value"] for r in rows}


class PromptStore:
    """Prompts by name in a folder of the driver."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not re.fullmatch(r"[\w-]+", name):
            raise ValueError(f"bad prompt name: {name}")
        return self.folder / f"{name}.txt"

    def list(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.txt"))

    def get(self, name: str) -> str:
        return self._path(name).read_text(encoding="utf-8")

    def create(self, name: str, text: str) -> None:
        with self._path(name).open("x", encoding="utf-8") as f:
            f.write(text)

    def update(self, name: str, text: str) -> None:
        if not self._path(name).exists():
            raise FileNotFoundError(name)
        self._path(name).write_text(text, encoding="utf-8")

    def delete(self, name: str) -> bool:
        there = self._path(name).exists()
        self._path(name).unlink(missing_ok=True)
        return there


class UploadStore:
    """Uploaded files in a folder of any file system that Spark reaches, each under an id of its own: id/name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, name: str, data: bytes) -> tuple[str, str]:
        """(file_id, stored path). Only the last part of a name counts."""
        name = name.replace("\\", "/").rsplit("/", 1)[-1]
        if name in ("", ".", ".."):
            raise ValueError("a file name is needed")
        ident = str(uuid.uuid4())
        files, path = self._at(ident, name)
        out = files.create(path)
        try:
            out.write(data)
        finally:
            out.close()
        return ident, path.toString()

    def find(self, ident: str) -> str | None:
        """The stored path of an id."""
        if not re.fullmatch(r"[0-9a-f-]{36}", ident):
            return None
        files, path = self._at(ident)
        return files.listStatus(path)[0].getPath().toString() if files.exists(path) else None

    def delete(self, ident: str) -> bool:
        files, path = self._at(ident)
        return bool(re.fullmatch(r"[0-9a-f-]{36}", ident)) and files.delete(path, True)


def save_history(states: DataFrame, path: str, key: str, ts: str, most: int = 50) -> None:
    """The last `most` states of each key, as JSON files."""
    newest = F.row_number().over(W.partitionBy(key).orderBy(F.desc(ts)))
    states.withColumn("__n", newest).where(F.col("__n") <= most).drop("__n").write.mode("overwrite").json(path)


def load_history(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def databases_from_env(env: Mapping[str, str]) -> dict[str, str]:
    """URLs of databases by lower-case name, from settings DB_<NAME>_URL, or from DB_<NAME>_TYPE, _USERNAME, _PASSWORD (none), _HOSTNAME
    (localhost), _PORT (5432) and _NAME; those of the second kind win. Incomplete ones are left out, and so are all where
    DISABLE_DATABASES is true."""
    if env.get("DISABLE_DATABASES", "").lower() in ("true", "1", "yes", "on"):
        return {}
    found = {m[1].lower(): v for k, v in env.items() if (m := re.fullmatch(r"DB_(.+)_URL", k))}
    for name in [m[1] for k in env if (m := re.fullmatch(r"DB_(.+)_TYPE", k))]:
        said = lambda part, default="": env.get(f"DB_{name}_{part}", default)  # noqa: B023, E731
        if said("TYPE") and said("USERNAME") and said("NAME"):
            found[name.lower()] = f"{said('TYPE')}://{said('USERNAME')}:{said('PASSWORD')}@{said('HOSTNAME', 'localhost')}:{said('PORT', '5432')}/{said('NAME')}"
    return found


class Collection:
    """A named set of vectors with payload, of one dimension: a Parquet table, or with a key a Store, where rows of known ids are replaced."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, key: str | None = None):
        self.spark, self.path, self.dimension = spark, path, dimension
        self.store = Store(spark, path, key) if key else None

    def read(self) -> DataFrame:
        return self.store.read() if self.store else self.spark.read.parquet(self.path)

    def exists(self) -> bool:
        try:
            return bool(self.read().columns)
        except (AnalysisException, LookupError):
            return False

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def add(self, df: DataFrame, vec_col: str = "embedding", recreate: bool = False) -> None:
        """Appends, or with a key upserts; a vector of another dimension fails the write. recreate replaces the collection."""
        size = F.size(vec_col)
        wrong = F.raise_error(F.concat(F.lit(f"dimension must be {self.dimension}, not "), size.cast("string")))
        checked = df.withColumn(vec_col, F.when(size == self.dimension, F.col(vec_col)).otherwise(wrong))
        if self.store:
            if recreate:
                self.drop()
            self.store.upsert(checked)
        else:
            checked.write.mode("overwrite" if recreate else "append").parquet(self.path)

    def drop(self) -> None:
        """The collection is gone, with its folder."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def clear(self) -> None:
        if self.store:
            self.store.delete(self.read())
            return
        schema = self.read().schema
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(self.path)
