"""BI workbooks as tables: datasources, fields and worksheets of many files in one job, and checks on them."""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger XML is refused, since one task holds a workbook whole.
MAX_XML = 64 << 20
# Connection classes, and functions of the workbook format that filter by user.
LIVE_CLASSES = ("snowflake",)
EXTRACT_CLASSES = ("hyper", "dataengine", "extract")

SCHEMA = "path string, part string, datasource string, name string, caption string, formula string, sheet string, kind string, detail string, flag boolean"

_LOD = r"(?i)\{\s*FIXED"
_LITERAL = r"(?<![\w\[.])[0-9]+(?:\.[0-9]+)?(?![\w\]])|#[^#]+#"
_USER = r"(?i)\b(?:USERNAME|FULLNAME|ISMEMBEROF|ISUSERNAME|ISFULLNAME|USERDOMAIN|USERATTRIBUTE|USERATTRIBUTEINCLUDES)\s*\("
_CALCULATION = r"\[(Calculation_[0-9]+)\]"


def xml_of(content: bytes) -> bytes:
    """The workbook XML of a plain or packed file."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            inner = next((i for i in packed.infolist() if i.filename.lower().endswith(".twb")), None)
            if inner is None:
                raise ValueError("no workbook in the package")
            if inner.file_size > MAX_XML:
                raise ValueError("workbook XML is too large")
            content = packed.read(inner)
    if len(content) > MAX_XML:
        raise ValueError("workbook XML is too large")
    return content


def ratio_of_aggregate(formula: str) -> bool:
    """An aggregate whose argument multiplies or divides at least two fields."""
    for m in re.finditer(r"(?i)\b(?:SUM|AVG|MIN|MAX|COUNT|COUNTD|MEDIAN)\s*\(", formula):
        depth, at = 1, m.end()
        while at < len(formula) and depth:
            depth += {"(": 1, ")": -1}.get(formula[at], 0)
            at += 1
        inside = formula[m.end() : at - 1 if not depth else at]
        if re.search(r"[*/]", inside) and len(re.findall(r"\[[^\]]+\]", inside)) >= 2:
            return True
    return False


def _relation(connection, relation) -> tuple[str, str]:
    """(kind, detail) of a datasource's relation: a table, custom SQL, or refused with the reason."""
    style = connection.get("class", "") if connection is not None else ""
    if relation is None:
        return "refused", "no relation"
    sort = relation.get("type", "")
    if sort in ("join", "union", "collection"):
        return "refused", sort
    if style in EXTRACT_CLASSES:
        return "refused", "extract only"
    if style == "sqlproxy":
        return "refused", "published"
    if style not in LIVE_CLASSES:
        return "refused", f"unsupported connection: {style or 'none'}"
    if sort == "text":
        return ("custom_sql", (relation.text or "").strip()) if (relation.text or "").strip() else ("refused", "unrecognised")
    if sort == "table":
        names = re.findall(r"\[((?:[^\]]|\]\])*)\]", relation.get("table", ""))
        names = [connection.get("dbname", ""), connection.get("schema", "")][: max(0, 3 - len(names))] + names
        return "table", ".".join(n.replace("]]", "]") for n in names if n)
    return "refused", "unrecognised"


def parse(path: str, content: bytes) -> list[dict]:
    """Rows of all parts of one workbook; one row of part `error` if it can't be read."""
    row = dict.fromkeys([c.split()[0] for c in SCHEMA.split(", ")]) | {"path": path}
    try:
        root = ET.fromstring(xml_of(content))
    except (ValueError, ET.ParseError, zipfile.BadZipFile) as error:
        return [row | {"part": "error", "detail": str(error)}]
    out = []
    for source in root.findall("./datasources/datasource"):
        if source.get("name") == "Parameters":
            continue
        label = source.get("caption") or source.get("name")
        named = source.find("./connection/named-connections/named-connection/connection")
        connection = named if named is not None else source.find("./connection")
        relation = source.find("./connection/relation")
        kind, detail = _relation(connection, relation)
        extract = source.find("./extract")
        out.append(row | {"part": "datasource", "datasource": label, "name": source.get("name"), "kind": kind, "detail": detail, "flag": extract is not None and extract.get("enabled", "true") == "true"})
        out.append(row | {"part": "published", "datasource": label, "flag": connection is not None and connection.get("class") == "sqlproxy"})
        for column in source.findall("./column"):
            formula = column.find("./calculation")
            out.append(row | {"part": "field", "datasource": label, "name": column.get("name", "").strip("[]"), "caption": column.get("caption"), "formula": formula.get("formula") if formula is not None else None})
    for sheet in root.findall("./worksheets/worksheet"):
        totals = sheet.find(".//grandtotals") is not None or any("total" in (s.get("attr") or "").lower() and s.get("value") == "true" for s in sheet.iter("format"))
        out.append(row | {"part": "sheet", "sheet": sheet.get("name"), "flag": totals, "detail": str(len(sheet.findall(".//filter")))})
        used = {m for c in sheet.iter("column-instance") for m in re.findall(r"\[([^\]]+)\]", c.get("column") or "")} | {c.get("name", "").strip("[]") for c in sheet.iter("column")}
        out += [row | {"part": "use", "sheet": sheet.get("name"), "name": n} for n in sorted(used)]
    return out


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All parts of all workbooks under a path or glob, one row each."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def relations(parts: DataFrame) -> DataFrame:
    """path, datasource, kind, detail, has_extract of every datasource; what can't be compared is kept as refused, with the reason."""
    return parts.filter("part = 'datasource'").select("path", "datasource", "kind", "detail", F.col("flag").alias("has_extract"))


def findings(parts: DataFrame, certified: tuple[str, ...] = (), field_regex: str | None = None, max_filters: int = 12, need_user_filter: bool = False) -> DataFrame:
    """path, check, status, subject of all static workbook checks, for a whole estate at once."""
    scrubbed = F.regexp_replace(F.regexp_replace(F.regexp_replace("formula", r"'[^']*'|\"[^\"]*\"", ""), r"//[^\n]*", ""), r"\[[^\]]*\]\.\[[^\]]*\]", "")
    fields = parts.filter("part = 'field'")
    calcs = fields.filter("formula is not null").withColumn("shown", F.coalesce("caption", "name"))
    sources, sheets = parts.filter("part = 'datasource'"), parts.filter("part = 'sheet'")
    is_ratio = F.udf(lambda f: ratio_of_aggregate(f or ""), "boolean")  # formulas are short and few

    def found(df: DataFrame, check: str, status: str, subject) -> DataFrame:
        return df.select("path", F.lit(check).alias("check"), F.lit(status).alias("status"), F.col(subject).alias("subject") if isinstance(subject, str) else subject.alias("subject"))

    published = parts.filter("part = 'published'").select("path", "datasource", F.col("flag").alias("published"))
    uncertified = sources.join(published, ["path", "datasource"]).filter(~F.col("published") & ~F.upper("datasource").isin(*[c.upper() for c in certified]))
    mentioned = calcs.select("path", F.explode(F.regexp_extract_all("formula", F.lit(r"\[([^\]]+)\]"), F.lit(1))).alias("name"))
    used = parts.filter("part = 'use'").select("path", "name").union(mentioned).distinct()
    refers = calcs.select("path", "shown", F.explode(F.regexp_extract_all(scrubbed, F.lit(_CALCULATION), F.lit(1))).alias("target"))
    known = fields.select("path", F.col("name").alias("target")).distinct()
    averages = calcs.filter(F.col("formula").rlike(r"(?i)\bAVG\s*\(") | is_ratio("formula") | F.col("formula").contains("/")).select("path", "shown").groupBy("path").agg(F.min("shown").alias("shown"))
    out = [
        found(sources.filter("kind = 'custom_sql'"), "T-SRC-001", "WARN", "datasource"),
        found(sources.filter("flag"), "T-SRC-002", "WARN", "datasource"),
        found(uncertified, "T-SRC-003", "FAIL" if certified else "WARN", "datasource"),
        found(calcs.filter(F.col("formula").rlike(_LOD)), "T-LOD-001", "WARN", "shown"),
        found(calcs.filter(is_ratio("formula")), "T-CALC-001", "WARN", "shown"),
        found(calcs.filter(F.regexp_replace(scrubbed, r"\[[^\]]*\]", "").rlike(_LITERAL)), "T-CALC-002", "WARN", "shown"),
        found(refers.join(known, ["path", "target"], "left_anti"), "T-CALC-003", "FAIL", F.concat_ws(" -> ", "shown", "target")),
        found(calcs.join(used, ["path", "name"], "left_anti"), "T-UNUSED-001", "WARN", "shown"),
        found(sheets.groupBy("path").agg(F.sum(F.col("detail").cast("int")).alias("n")).filter(F.col("n") > max_filters), "T-FILT-001", "WARN", F.col("n").cast("string")),
        found(sheets.filter("flag").select("path", "sheet").join(averages, "path"), "T-TOTAL-001", "WARN", F.concat_ws(": ", "sheet", "shown")),
        found(parts.filter("part = 'error'"), "T-READ-001", "ERROR", "detail"),
    ]
    if field_regex:
        out.append(found(calcs.filter(~F.col("shown").rlike(field_regex)), "T-NAME-001", "WARN", "shown"))
    if need_user_filter:
        safe = calcs.filter(F.col("formula").rlike(_USER)).select("path").distinct()
        out.append(found(parts.select("path").distinct().join(safe, "path", "left_anti"), "T-RLS-001", "FAIL", "path"))
    total = out[0]
    for df in out[1:]:
        total = total.union(df)
    return total
