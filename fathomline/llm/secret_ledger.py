"""Secret scans over an incremental blob ledger.

Every text is a blob named by its SHA-256. A ledger holds (blob, rule version) pairs already scanned, with their spans.
``scan`` lists the blobs that the ledger doesn't have for the current rule version, scans each of them once, and joins
ledger and new findings back to every path (document) that holds the blob; ``new_entries`` is what a next run's ledger
gains; ``scan_stored`` keeps the ledger as a table that further runs read and append to. Blobs are chosen by the smallest id that holds
them, so that texts move by document id and never by blob: a text with a million copies, or a row repeated as often, is scanned once in a task, and the join back deals
its paths to many tasks.

Defined results: null is the empty text, which is a blob like any other; repeated rows repeat in the result; an id may
hold several texts, each with its own blob; rows whose doc_id is null are scanned where they are; a missing or empty
ledger means that everything is unseen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import arrow_map, expanded, materialise, squeezed, utf8
from fathomline.operators.skew import attach
from fathomline.sources.shared import new_path, stored

#: Base rules, then those that this method adds. A match of the pattern whose counted part is too short is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Least characters: of an assigned value, of an access key and of a run of hex digits.
LEAST = {"assign": 6, "access": 20, "hex": 24}
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST["hex"])
ADDED = {
    # to the END line, or else over headers and base64 lines
    "pem": re.compile(
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:(?:\s|\\[nr])*(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]{16,}={0,2})*(?:(?:\s|\\[nr])+[A-Za-z0-9+/]+={1,2})?)"
    ),
    # whole runs of the alphabet, each tried once; where the first part begins is looked up inside it
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)(?=\.eyJ[A-Za-z0-9_-]{8})\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{8,}+"),
    "ghtoken": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "urlpass": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]{3,}@"),
}
KINDS = ["assign", "access", "hex", *ADDED]
MARKS = {"pem": "PRIVATE", "jwt": "eyJ", "ghtoken": "gh", "slack": "xox", "urlpass": "://"}
#: Changes with the rules: pairs of another version count as unseen.
RULE_VERSION = hashlib.sha256(repr([[(p.pattern, p.flags) for p in (ASSIGN, ACCESS, HEX, *ADDED.values())], sorted(LEAST.items()), sorted(MARKS.items()), KINDS]).encode()).hexdigest()[:16]

Span = tuple[int, int, int]
_KEYWORD = re.compile(r"pass|secret|token|api", re.IGNORECASE | re.ASCII)


def find_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of every secret, in code points, by start and then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if _KEYWORD.search(text) else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (kind, pattern) in enumerate(ADDED.items(), 3):
        if MARKS[kind] in text and kind == "jwt":
            spans += [(a, k, z) for a, z in _jwt(text, pattern)]
        elif MARKS[kind] in text:
            spans += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(spans)


def _jwt(text: str, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Tokens of three parts; the first begins at the first eyJ of its run that has eight characters behind it."""
    out, at = [], 0
    while m := pattern.search(text, at):
        begin = text.find("eyJ", m.start(1), m.end(1))
        if begin >= 0 and m.end(1) - begin >= 11:
            out.append((begin, m.end()))
            at = m.end()
        else:
            at = m.end(1)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def redact(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """``text`` with every run of overlapping spans replaced by ``mask``."""
    out, at, end = [], 0, -1
    for a, _, z in spans:
        if a < end:
            end = at = max(end, z)
            continue
        out += [text[at:a], mask]
        end = at = z
    return "".join([*out, text[at:]])


ENTRY = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _findings(texts: list[bytes]) -> list[pa.Array]:
    rows = []
    for t in texts:
        spans = find_spans(t.decode())
        base = [s for s in spans if s[1] < 3]
        rows.append([*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]


def _blob() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def paths(documents: DataFrame) -> DataFrame:
    """doc_id and blob (SHA-256 of the text as UTF-8) of every row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), _blob().alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored entries, or None where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(ENTRY).parquet(path)


def unseen(held: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """doc_id and blob: one path for each blob without an entry of this rule version."""
    first = held.where("doc_id is not null").groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    return first.select("doc_id", "blob")


def scan_blobs(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ledger entries (blob, rule_version and findings) of the chosen paths' blobs, each scanned once."""
    texts = squeezed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), _blob().alias("blob"), "text"))
    found = arrow_map(texts.join(chosen, ["doc_id", "blob"]).select("blob", "squeezed"), f"blob string, rule_version string, {FINDINGS}", _scanner())
    return found.dropDuplicates(["blob"])  # repeated rows of a path that came to several tasks


def _scanner() -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
    """Ledger entries of a batch of (blob, squeezed); a blob that the task has scanned, as repeated rows of a path bring it, is passed over."""
    seen: set[bytes] = set()  # of one task: each unpickles it empty

    def scan_batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        fresh = []
        for k, blob in enumerate(b.column(0).to_pylist()):
            if (name := bytes.fromhex(blob)) not in seen:
                seen.add(name)
                fresh.append(k)
        if not fresh:
            return None
        b = b.take(pa.array(fresh))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([RULE_VERSION] * b.num_rows), *_findings(expanded(b.column(1)))], ["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan_batch


def scan(documents: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, and the entries that this run adds to the ledger (checkpointed: it is read twice or more).

    The first: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.
    """
    held = materialise(paths(documents))
    new = materialise(scan_blobs(documents, unseen(held, ledger)))
    known = new if ledger is None else new.unionByName(ledger.where(F.col("rule_version") == RULE_VERSION).select(new.columns))
    return _of_paths(documents, held, known), new


def scan_stored(documents: DataFrame, path: str) -> DataFrame:
    """``scan`` over the ledger stored at ``path``: blobs without an entry of this rule version are scanned and appended to it,
    and the findings of every path are read from it. Nothing needs to be stored there yet."""
    spark = documents.sparkSession
    held = stored(paths(documents), "paths")
    scan_blobs(documents, unseen(held, read_ledger(spark, path))).write.mode("append").option("compression", "zstd").parquet(path)
    return _of_paths(documents, held, read_ledger(spark, path).where(F.col("rule_version") == RULE_VERSION).dropDuplicates(["blob"]))


def _of_paths(documents: DataFrame, held: DataFrame, known: DataFrame) -> DataFrame:
    """Findings of every path: those of its blob; the copies of a blob are dealt to many tasks. Rows without an id are scanned here."""
    names = [c.split()[0] for c in FINDINGS.split(", ")]
    with_id = attach(held.where("doc_id is not null"), known.select("blob", *names), ["blob"], "doc_id").select("doc_id", *names, "blob")
    lost = arrow_map(
        documents.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text"), f"doc_id long, {FINDINGS}",
        lambda b: pa.RecordBatch.from_arrays([b.column(0), *_findings(utf8(b.column(1)))], ["doc_id", *names]),
    )
    return with_id.unionByName(lost.withColumn("blob", F.lit(None).cast("string")))


def redact_documents(documents: DataFrame, ledger: str | None = None) -> DataFrame:
    """``documents`` with every secret in its text masked and ``n_chars``, where there is one, counted anew.

    The spans come from the ledger stored at ``ledger`` (a fresh one without it); only rows that have any are changed. Rows without an id are scanned where they are.
    """
    names, kinds = documents.columns, {f.name: f.dataType.simpleString() for f in documents.schema}
    at = names.index("text")
    known = scan_stored(documents.where("doc_id is not null"), ledger or new_path(documents.sparkSession, "ledger"))
    spans = known.where("spans != ''").select(F.col("doc_id").alias("found_id"), F.col("blob").alias("found_blob"), F.col("spans").alias("found_spans")).dropDuplicates(["found_id", "found_blob"])
    marked = documents.join(spans, (F.col("doc_id").cast("long") == F.col("found_id")) & (_blob() == F.col("found_blob")), "left").drop("found_id", "found_blob")

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        masked, changed = [], []
        for doc, text, said in zip(b.column(names.index("doc_id")).to_pylist(), b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
            found = [(int(a), 0, int(z)) for _, a, z in (s.split(":") for s in said.split(","))] if said else find_spans(text) if doc is None and text else []
            changed.append(bool(found))
            masked.append(redact(text, found) if found else text)
        columns = [pa.array(masked, pa.string()) if k == at else b.column(k) for k in range(len(names))]
        if "n_chars" in names:
            k = names.index("n_chars")
            columns[k] = pa.array([len(m) if c else o for o, m, c in zip(b.column(k).to_pylist(), masked, changed, strict=True)], b.column(k).type)
        return pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(marked.select(*names, "found_spans"), ", ".join(f"`{n}` {kinds[n]}" for n in names), rows)
