"""From files to Markdown documents: metadata, front matter, body, files, failure documents and reports.

A file is a row from start to end; what can't be read becomes a failure document and a row of the report, never an error of
the job. No operator reads the clock: the time of a run is a parameter.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import metadata as M
from quillspark.functions import prose
from quillspark.functions import text as X
from quillspark.operators import corpus as O
from quillspark.operators import markdown
from quillspark.session import settled
from quillspark.sources import readers, sinks

# Statuses of a report in their order, and the names of its rows.
STATUSES = ["success", "partial", "skip", "failed", "password_protected", "corrupted_file", "unsupported_format"]
ROWS = [
    ("성공 (Success)", "success"), ("부분성공/검토필요 (Partial)", "partial"), ("기존 건너뜀 (Skip)", "skip"), ("암호 문서 (Password Protected)", "password_protected"),
    ("손상 파일 (Corrupted File)", "corrupted_file"), ("일반 실패 (Failed)", "failed"),
]
# Front matter in its order: field, how its value is written, what stands for a missing value (None: the field is left out).
TEXT, PLAIN, QUOTED, TAGS, LIST, BOOLEAN = "text", "plain", "quoted", "tags", "list", "boolean"
FIELDS = [
    ("title", TEXT, ""), ("category", TEXT, X.DEFAULT_CATEGORY), ("type", QUOTED, "document"), ("topic", TEXT, None), ("summary", TEXT, M.NO_SUMMARY),
    ("source", TEXT, ""), ("source_path", TEXT, ""), ("source_rel_path", TEXT, None), ("source_type", QUOTED, ""), ("created", PLAIN, ""), ("converted", PLAIN, ""),
    ("status", QUOTED, "success"), ("decision_status", QUOTED, "accepted"), ("tags", TAGS, []), ("aliases", LIST, []), ("id", QUOTED, ""),
    ("description", TEXT, M.NO_SUMMARY), ("source_file", TEXT, ""), ("conversion_method", QUOTED, "native"), ("converted_from", QUOTED, ""),
    ("output_file", TEXT, ""), ("language", QUOTED, "ko"), ("created_at", QUOTED, ""), ("updated_at", QUOTED, ""), ("doc_category", TEXT, X.DEFAULT_CATEGORY),
    ("topics", LIST, []), ("keywords", LIST, []), ("entities", LIST, []), ("related_documents", LIST, []), ("ocr_required", BOOLEAN, "false"),
    ("ocr_confidence", QUOTED, "unknown"), ("review_required", BOOLEAN, "false"), ("errors", LIST, []),
]


def front_matter(values: dict[str, Column], extra: dict[str, Column] | None = None) -> Column:
    """The front matter of a document. A missing or null value stands as its default; null or empty lists as []; extra fields follow."""
    def written(key: str, kind: str, default) -> Column:
        given = values.get(key)
        if kind in (TAGS, LIST):
            if given is None:
                return F.lit(f"{key}: []")
            item = (lambda x: x) if kind == TAGS else sinks.quoted
            return F.when(F.coalesce(F.size(given), F.lit(0)) > 0, F.concat(F.lit(f"{key}:"), F.array_join(F.transform(given, lambda x: F.concat(F.lit("\n  - "), item(x))), ""))).otherwise(f"{key}: []")
        value = given.cast("string") if given is not None else F.lit(None).cast("string")
        text = sinks.quoted(F.coalesce(value, F.lit(default or ""))) if kind in (TEXT, QUOTED) else F.coalesce(value, F.lit(default or ""))
        line = F.concat(F.lit(f"{key}: "), text)
        return F.when(value.isNotNull(), line) if default is None else line

    fields = [written(*f) for f in FIELDS]
    fields += [F.concat(F.lit(f"{k}: "), sinks.quoted(v.cast("string"))) for k, v in (extra or {}).items() if k not in values]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *fields), F.lit("\n---\n"))


def front_text(values: dict[str, str | list[str]]) -> str:
    """front_matter() of one document."""
    lines = []
    for key, kind, default in FIELDS:
        value = values.get(key)
        if kind in (TAGS, LIST):
            lines.append(f"{key}:" + "".join(f"\n  - {x if kind == TAGS else sinks.quoted_text(x)}" for x in value) if value else f"{key}: []")
        elif value is not None or default is not None:
            value = default if value is None else value
            lines.append(f"{key}: {sinks.quoted_text(value) if kind in (TEXT, QUOTED) else value}")
    return "---\n" + "\n".join(lines) + "\n---\n"


def body(values: dict[str, str | list[str]], content: str) -> str:
    """Title, overview, content without a repeated title, quality notes and origin, tidied."""
    v = lambda key, default="": values.get(key) or default
    notes = lambda head, *rows: "\n".join([f"## {head}\n", *(f"- {name}: {x}" for name, x in rows), ""])
    content = prose.strip(content)
    first, _, rest = content.partition("\n")
    if first.startswith("# ") and v("title") in first:
        content = prose.strip(rest)
    parts = [
        f"# {v('title')}\n",
        notes("문서 개요", ("원본 파일명", v("source_file")), ("문서 유형", v("category")), ("작성·시행일자", v("created_at")), ("주요 주제", ", ".join(v("topics", [])) or "일반"), ("핵심 요약", v("summary"))),
        *([f"## 본문 내용\n\n{content}\n"] if content else []),
        notes("추출 품질 및 검토 사항", ("OCR 신뢰도", v("ocr_confidence", "unknown")), ("인식 불명확 구간", "없음"), ("원본 구조 손상 가능성", "낮음"), ("추가 확인 필요 사항", "없음")),
        notes("원본 정보", ("원본 파일", v("source_file")), ("원본 경로", v("source_path")), ("변환 방식", v("conversion_method", "native")), ("생성일시", v("created_at"))),
    ]
    return prose.tidy("\n\n".join(parts))


def document(f: dict, raw: bytes | None, now: str, chain: list[readers.Reader]) -> tuple[str, str | None, str]:
    """status, message, markdown of a file: source, name, rel_path, stem, ext, suffix, target, doc."""
    status, _, text, error = readers.convert(f["suffix"], raw, chain)
    values = {
        "source": f["name"], "source_file": f["name"], "source_path": f["source"], "source_rel_path": f["rel_path"], "source_type": readers.TYPES.get(f["ext"], f["ext"]),
        "created": now[:10], "converted": now[:10], "created_at": now, "updated_at": now, "status": status, "id": f["doc"], "converted_from": f".{f['ext']}", "output_file": f["target"],
    }
    if status not in ("success", "partial"):
        reason = error or status
        values |= {"title": f["stem"], "summary": "변환 실패 문서", "description": "변환 실패 문서", "conversion_method": "none", "errors": [reason]}
        return status, reason, f"{front_text(values)}\n# {f['stem']}\n\n> [!CAUTION]\n> 변환 실패: {reason}\n"
    text = prose.refine(text)
    title, summary, category = M.title_of(text, f["name"]), M.summary_of(text), M.category_of(text, f["name"], f["source"])
    study = M.study_of(text, f"{f['source']} {title}")
    tags = M.tags_of(text, title, category, study)
    values |= {
        "title": title, "category": category, "type": "english_learning" if study else "document", "topic": tags[0] if tags else "일반", "summary": summary, "description": summary, "tags": tags,
        "language": M.language_of(text), "doc_category": category, "topics": tags[:3] or ["일반"], "keywords": tags[:5] or ["문서"], "entities": M.entities_of(text), "conversion_method": "native",
    }
    return status, None, markdown.cleaned(f"{front_text(values)}\n{body(values, text)}")


def normal_path(c: Column) -> Column:
    """A path as typed or dropped: without quotes and blanks around it, with forward slashes, no empty or dot steps, composed letters."""
    from quillspark.functions.unicode import nfc

    bare = F.regexp_replace(F.replace(F.regexp_replace(X.text(c), r"^[ \t\r\n'\"]+|[ \t\r\n'\"]+$", ""), F.lit('\\"'), F.lit('"')), '^"+|"+$', "")
    slashed = F.regexp_replace(F.translate(bare, "\\", "/"), r"(?<!^)(?<![A-Za-z]{2}:)/{2,}", "/")
    return nfc(F.regexp_replace(F.regexp_replace(slashed, r"(?<=/)(?:\./)+", ""), r"(?<=.)/$", ""))


def relative_path(path: Column, root: str) -> Column:
    """The path below a root folder or the folder above it; null elsewhere."""
    roots = [r.rstrip("/") + "/" for r in (root, posixpath.dirname(root.rstrip("/"))) if r.strip("/")]
    return F.coalesce(*(F.when(path.startswith(r), F.substr(path, F.lit(len(r) + 1))) for r in roots), F.lit(None).cast("string"))


def existing(spark: SparkSession, out_dir: str) -> DataFrame:
    """source_path, source_rel_path, source_file, source_parent of the documents in a folder, from the front matter in their first lines."""
    none = "source_path string, source_rel_path string, source_file string, source_parent string"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], none)
    head = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.md").text(out_dir).select(F.substring("value", 1, 4096).alias("head"))
    field = lambda key: F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_extract("head", rf'(?m)^{key}: ("(?:[^"\\]|\\.)*")$', 1), F.lit("}")), "$.v")
    found = head.select(*(field(k).alias(k) for k in ("source_path", "source_rel_path", "source_file")))
    return found.withColumn("source_parent", F.regexp_extract("source_path", r"([^/]+)/[^/]*$", 1)).where("source_path is not null")


def converted(files: DataFrame, now: str, root: str = "/", done: DataFrame | None = None, skip_scanned: bool = False) -> DataFrame:
    """source, target, status, message, markdown: a row for each file (path, content, modificationTime).

    now: the run's time in ISO 8601, UTC. done: what existing() found; those files are skipped, as are images if
    skip_scanned. Files that can't be read, or whose text is empty, get a failure document. Targets don't collide.
    """
    day = now[:10].replace("-", "")
    path = F.regexp_replace(normal_path(F.col("path")), "^file:/*(?=/)", "")
    f = files.withColumns({"source": path}).withColumns({
        "name": F.regexp_extract("source", r"([^/]+)$", 1), "parent": F.regexp_extract("source", r"([^/]+)/[^/]*$", 1), "rel_path": relative_path(F.col("source"), root),
    })
    f = f.withColumns({"stem": F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), "ext": F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))})
    # names alone decide what is done under which target; that is settled first, so that no text is planned or read for it
    names = f.select("source", "stem", "ext", "name", "rel_path", "parent")
    targets = settled(O.target_names(names.select("source", "stem", "ext", "name").distinct()).select("source", "target"))
    skipped, fresh = [], names
    if done is not None:
        new = O.not_converted(names.select(F.col("source").alias("path"), "rel_path", "name", "parent"), done).select(F.col("path").alias("source"))
        skipped.append(names.join(new, "source", "left_anti").select("source", F.lit("이미 변환됨").alias("message")))
        fresh = names.join(new, "source", "left_semi")
    if skip_scanned:
        skipped.append(fresh.where(F.col("ext").isin(*readers.IMAGES)).select("source", F.lit("스캔/이미지 문서 제외 (OCR 생략)").alias("message")))
    todo, left = f, None
    if skipped:
        left = settled(reduce(DataFrame.unionByName, skipped).join(targets, "source"))
        todo = f.join(left.select("source").distinct(), "source", "left_anti")
    todo = todo.join(targets, "source").withColumns({
        "doc": X.doc_id(F.col("source"), F.col("modificationTime").cast("string"), day), "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)),
    })
    chains = dict(readers.READERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.drop_columns(["content"]).to_pylist()
            done = [document(f, raw.as_py(), now, chains.get(f["suffix"], [])) for f, raw in zip(rows, b["content"])]
            cols = list(zip(*done)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b["source"], b["target"], *(pa.array(c, pa.string()) for c in cols)], ["source", "target", "status", "message", "markdown"])

    # one pass for all files: from bytes to the Markdown that is written, each in one call
    fields = ["source", "name", "rel_path", "stem", "ext", "suffix", "target", "doc", "content"]
    fine = todo.select(fields).mapInArrow(run, "source string, target string, status string, message string, markdown string")
    if left is None:
        return fine
    return fine.unionByName(left.select("source", "target", F.lit("skip").alias("status"), "message", F.lit(None).cast("string").alias("markdown")))


def write(docs: DataFrame, out_dir: str) -> DataFrame:
    """Writes each document to its target in a folder that all executors reach; source, target, status, message of every row.

    A file is written beside its place and then moved there, so a task that is run again writes the same file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(out_dir if "://" in out_dir or out_dir.startswith("file:") else f"file://{out_dir}")
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, text in zip(b["target"].to_pylist(), b["markdown"].to_pylist()):
                if text is not None:
                    with system.open_output_stream(f"{base}/.{name}.part") as out:
                        out.write(text.encode())
                    system.move(f"{base}/.{name}.part", f"{base}/{name}")
            yield b.select(["source", "target", "status", "message"])

    return docs.mapInArrow(run, "source string, target string, status string, message string")


def counts(details: DataFrame) -> dict[str, int]:
    """Files by status, in the report's order, with their total."""
    found = {r[0]: r[1] for r in details.groupBy("status").count().collect()}  # a row for each status
    other = sum(n for s, n in found.items() if s not in STATUSES)
    out = {s: found.get(s, 0) + (other if s == "failed" else 0) for s in STATUSES}
    return {"total": sum(found.values()), **out}


def summary_lines(details: DataFrame, n: dict[str, int], now: str, out_dir: str, report_dir: str) -> DataFrame:
    """The Markdown summary as lines (at, line): the numbers, then a row for each file by name."""
    spark = details.sparkSession
    bad = n["failed"] + n["password_protected"] + n["corrupted_file"]
    head = [
        "# 문서 변환 일괄 처리 보고서", "", f"- 실행 일시: {now}", f"- 결과 마크다운 폴더: {out_dir}", f"- 변환 리포트 폴더: {report_dir}", f"- 전체 대상: {n['total']} 건",
        f"- 성공: {n['success']} 건, 부분성공/검토필요: {n['partial']} 건, 건너뜀: {n['skip']} 건, 실패: {bad} 건", "", "## 처리 결과 통계", "", "| 상태 | 건수 |", "|---|---|",
        *(f"| {label} | {n[s]} |" for label, s in ROWS), "", "## 상세 처리 내역", "", "| 원본 파일 | 변환 상태 | 결과 파일 | 비고 |", "|---|---|---|---|",
    ]
    top = spark.createDataFrame([("", i, x) for i, x in enumerate(head)], "source string, at int, line string")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.regexp_extract("source", r"([^/]+)$", 1), "status", F.coalesce("target", F.lit("-")), F.coalesce("message", F.lit(""))), F.lit(" |"))
    return top.unionByName(details.select("source", F.lit(len(head)).alias("at"), row.alias("line"))).orderBy("at", "source")


def _put(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def report(details: DataFrame, now: str, out_dir: str, report_dir: str) -> dict:
    """Writes the latest report and one under the run's time: numbers as JSON, details as JSON lines, the summary in Markdown."""
    spark, n = details.sparkSession, counts(details)
    data = {"timestamp": now, "output_directory": out_dir, "report_directory": report_dir, "counts": n}
    stamp = now[:19].replace("-", "").replace(":", "").replace("T", "_")
    for name in ("_conversion_report", f"conversion_report_{stamp}"):
        _put(spark, f"{report_dir}/{name}.json", json.dumps(data, ensure_ascii=False, indent=2))
        sinks.write_report(details, f"{report_dir}/{name}_details")
    for name in ("_conversion_summary", f"conversion_summary_{stamp}"):
        summary_lines(details, n, now, out_dir, report_dir).select("line").write.mode("overwrite").text(f"{report_dir}/{name}")
    return data


def convert_batch(spark: SparkSession, inputs: str, out_dir: str, report_dir: str, now: str, overwrite: bool = False, recursive: bool = True, skip_scanned: bool = False, root: str = "/") -> DataFrame:
    """Converts all documents below a folder: files, failure documents and reports; source, target, status, message of each.

    The details are written with the report and read from there, so nothing is converted twice.
    """
    done = None if overwrite else existing(spark, out_dir)
    details = write(converted(readers.scan(spark, inputs, recursive), now, root, done, skip_scanned), out_dir)
    kept = f"{report_dir}/.details"
    details.write.mode("overwrite").parquet(kept)
    details = spark.read.parquet(kept)
    report(details, now, out_dir, report_dir)
    return details
