"""Documents as trees of files: a data source whose writer lists in manifests only what a finished job wrote, and its reader."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Layout: one folder a module below that of all packages (an option), a file a definition, a manifest a module, and what the tree is
#: at its root.
ROOT, MANIFEST, PACKAGES = "format.json", "module.json", ".dist/pkg"
#: The file that lists a task's modules in the order of their folders, and how many modules are moved at a time.
LIST, MOVERS = "list.jsonl", 16
COLUMNS = "package string, module string, family string, ord int, name string, access string, doc string, body string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_text(fs: pafs.FileSystem, path: str, text: str) -> None:
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(text.encode())


@dataclass
class Written(WriterCommitMessage):
    """The folder that one task wrote, and how many modules it lists there: names stay in files."""

    folder: str
    modules: int


class TreeWriter(DataSourceArrowWriter):
    """Tasks write modules with their manifests into folders of their own; a commit moves them into the tree, an abort deletes them."""

    def __init__(self, path: str, packages: str, overwrite: bool) -> None:
        self.path, self.packages, self.overwrite, self.job = path.rstrip("/"), packages.strip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        folder = f"_temporary/{self.job}/{uuid.uuid4().hex}"
        now, names, n = None, {"type": [], "value": []}, 0
        fs.create_dir(f"{root}/{folder}", recursive=True)
        listed = fs.open_output_stream(f"{root}/{folder}/{LIST}")

        def finish() -> None:
            write_text(fs, f"{root}/{folder}/tree/{n}/{MANIFEST}", json.dumps({"module": now[1], "types": names["type"], "values": names["value"]}, indent=2))
            listed.write((json.dumps(now) + "\n").encode())

        for batch in iterator:
            for row in batch.to_pylist():
                if (row["package"], row["module"]) != now:
                    if now is not None:
                        finish()
                        n += 1
                    now, names = (row["package"], row["module"]), {"type": [], "value": []}
                content = {"access": row["access"], "value": json.loads(row["body"])} | ({"doc": row["doc"]} if row["doc"] is not None else {})
                family, name = row["family"], row["name"]
                write_text(fs, f"{root}/{folder}/tree/{n}/{family}s/{name}.{family}.json", json.dumps(content, indent=2, ensure_ascii=False))
                if name not in names[family]:
                    names[family].append(name)
        if now is not None:
            finish()
            n += 1
        listed.close()
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        top, first = f"{root}/{self.packages}", None
        if self.overwrite and fs.get_file_info(top).type != pafs.FileType.NotFound:
            fs.delete_dir(top)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:  # a module's folders one after another, different modules beside each other
                made: dict[str, list[str]] = {}
                for i, line in enumerate(text_at(fs, f"{root}/{m.folder}/{LIST}").splitlines() if m and m.modules else []):
                    package, module = json.loads(line)
                    first = package if first is None else min(first, package)
                    made.setdefault(f"{top}/{package}/{module}", []).append(f"{root}/{m.folder}/tree/{i}")
                list(pool.map(lambda place: [self._place(fs, folder, place[0]) for folder in place[1]], made.items()))
        write_text(fs, f"{root}/{ROOT}", json.dumps({"formatVersion": "4.0.0", "distribution": "Library", "packageName": first or "", "layout": "VfsMode"}, indent=2))
        self._clean(fs, root)

    def _place(self, fs: pafs.FileSystem, made: str, at: str) -> None:
        """A module's folder, whole; where it is there already, file by file, and its manifest, with both's names, last."""
        if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.NotFound:
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                fs.delete_dir(at)  # what no manifest lists
            fs.move(made, at)
            return
        held, new = (json.loads(text_at(fs, f"{folder}/{MANIFEST}")) for folder in (at, made))
        for f in fs.get_file_info(pafs.FileSelector(made, recursive=True)):
            if f.type == pafs.FileType.File and f.base_name != MANIFEST:
                to = at + f.path[len(made) :]
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                fs.move(f.path, to)
        both = {k: list(dict.fromkeys([*held[k], *new[k]])) for k in ("types", "values")}
        write_text(fs, f"{at}/{MANIFEST}", json.dumps({"module": held["module"]} | both, indent=2))

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*opened(self.path))

    def _clean(self, fs: pafs.FileSystem, root: str) -> None:
        for at in (f"{root}/_temporary/{self.job}", f"{root}/_temporary"):
            found = fs.get_file_info(at)
            if found.type == pafs.FileType.Directory and (at.endswith(self.job) or not fs.get_file_info(pafs.FileSelector(at))):
                fs.delete_dir(at)


def text_at(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode()


class TreeSource(DataSource):
    """``df.write.format("ir_tree").mode(...).save(path)`` for rows of ``COLUMNS``."""

    @classmethod
    def name(cls) -> str:
        return "ir_tree"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options.get("packages", PACKAGES), overwrite)


def write_documents(docs: DataFrame, defs: DataFrame, path: str, mode: str = "overwrite", packages: str = PACKAGES) -> None:
    """The definitions of ``docs`` (of version 4) as a tree: a file for each, manifests that tell their order.

    A module's rows are written by one task, beside the tree; modules are moved into it when all tasks are done, so a failed
    job leaves none listed. ``append`` adds to modules that are there. Definitions of unreadable documents are left
    out. Documents of one package go to one folder; of several definitions of one name the last written stays.
    """
    defs.sparkSession.dataSource.register(TreeSource)
    rows = defs.where("error IS NULL").hint("merge").join(docs.select("doc_id", "package"), "doc_id")
    rows = rows.selectExpr(*[c.split()[0] for c in COLUMNS.split(", ")]).repartition("package", "module").sortWithinPartitions("package", "module", "family", "ord")
    rows.write.format("ir_tree").option("packages", packages).mode(mode).save(path)


def read_documents(spark: SparkSession, path: str, packages: str = PACKAGES) -> DataFrame:
    """``(package, module, family, ord, name, access, doc, body)`` of a tree, as its manifests list them; files that no manifest lists are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(f"{path.rstrip('/')}/{packages.strip('/')}", wholetext=True)
    below = F.substring_index(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"/{packages.strip('/')}/", -1)
    found = files.select(below.alias("at"), F.col("value").alias("content"))
    manifests = found.where(F.endswith("at", F.lit(f"/{MANIFEST}")))
    module = F.get_json_object("content", "$.module")
    names = F.array(*[F.struct(F.lit(family).alias("family"), F.from_json(F.get_json_object("content", f"$.{family}s"), "array<string>").alias("names")) for family in ("type", "value")])
    listed = manifests.select(F.regexp_replace("at", f"/{MANIFEST}$", "").alias("folder"), module.alias("module"), F.explode(names).alias("of"))  # both families of one scan
    listed = listed.select("folder", "module", "of.family", F.posexplode("of.names").alias("ord", "name"))
    listed = listed.withColumn("at", F.concat_ws("/", "folder", F.concat("family", F.lit("s")), F.concat_ws(".", "name", "family", F.lit("json"))))
    bodies = found.select("at", F.get_json_object("content", "$.access").alias("access"), F.get_json_object("content", "$.doc").alias("doc"), F.get_json_object("content", "$.value").alias("body"))
    package = F.expr("substring(folder, 1, length(folder) - length(module) - 1)")
    return listed.join(bodies.hint("merge"), "at").select(package.alias("package"), "module", "family", "ord", "name", "access", "doc", "body")
