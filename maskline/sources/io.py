"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskline.plans.session import ship

def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row for each text-like file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("file"), F.col("value").alias("text"))


def read_session_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """timestamp, event, data (VARIANT) of a log of JSON lines, and malformed: the line where it isn't an entry, else null."""
    return session_log((spark.readStream if stream else spark.read).text(path))


def session_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with their line parsed: timestamp, event and data of an object that names its event; malformed holds any other line.
    Null and blank lines are no entries and not malformed: they go."""
    parsed = lines.filter(F.trim(F.col(line)) != "").withColumn("_v", F.try_parse_json(line))
    rows = parsed.withColumn("event", F.try_variant_get("_v", "$.event", "string"))
    at = F.try_to_timestamp(F.try_variant_get("_v", "$.timestamp", "string"))
    return rows.withColumns({"timestamp": at, "data": F.try_variant_get("_v", "$.data", "variant"), "malformed": F.when(F.col("event").isNull(), F.col(line))}).drop("_v", line)


def data_fields(log: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """log with columns of its data: name -> (path, type). A path that isn't there, or a value of another type, is null."""
    return log.withColumns({name: F.try_variant_get("data", path, kind) for name, (path, kind) in fields.items()})


def divided_log(log: DataFrame, path: str) -> DataFrame:
    """The entries of a log; its malformed lines are appended to a quarantine of text files."""
    log.filter("malformed is not null").select("malformed").write.mode("append").text(path)
    return log.filter("malformed is null").drop("malformed")


#: Fields of a portal's state; any others of a mission or message are left aside.
MISSION = "satellite_name mission_id operator launch_date orbit_type orbital_inclination apogee perigee ground_station_freq encryption_key_ref tle_line_1 tle_line_2 name username email phone company zip address about status vehicle dept desc empId".split()
MESSAGE = "id empId empInitials from time ciphertext".split()
OWN_NAMES = {"empId": "emp_id", "empInitials": "emp_initials", "from": "sender"}


def read_portal_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """missions, messages and forms (emp, form_id, submitted_at) of nested state files, under a given schema: parts that are missing,
    empty or not JSON give empty tables. A form's key is the person and the form, parted at its last underscore."""
    rows = lambda names: "array<struct<" + ",".join(f"`{n}`: string" for n in names) + ">>"
    schema = f"missions {rows(MISSION)}, messages {rows(MESSAGE)}, forms map<string, string>"
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("s"))
    out = {k: state.select(F.inline(f"s.{k}")) for k in ("missions", "messages")}
    out = {k: df.withColumnsRenamed(OWN_NAMES) for k, df in out.items()}
    keys = state.select(F.explode("s.forms").alias("key", "at"))
    out["forms"] = keys.select(F.regexp_extract("key", "(?s)^(.*)_", 1).alias("emp"), F.substring_index("key", "_", -1).alias("form_id"), F.try_to_timestamp("at").alias("submitted_at"))
    return out


def export_audit(df: DataFrame, path: str) -> None:
    df.withColumn("exported_at", F.current_timestamp()).write.mode("overwrite").json(path)


def conversation_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turns, text: each conversation as one text, its turns in order under their roles."""
    turn = F.struct("turn", F.concat(F.lit("## "), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit(""))).alias("t"))
    rows = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    return rows.select("conv_id", F.size("_t").alias("turns"), F.array_join(F.transform("_t", lambda x: x["t"]), "\n\n").alias("text"))


def export_conversations(df: DataFrame) -> DataFrame:
    """conv_id, turns, text as conversation_texts() gives them, with what is sensitive replaced by the conversation's tokens."""
    from maskline.operators.redact import scrub_in_scope

    return conversation_texts(scrub_in_scope(df, "conv_id", "turn")[0], "clean_text")


def quality_report(runs: DataFrame, sources: DataFrame, path: str) -> None:
    """Writes the tables of quality.report() under path."""
    from maskline.operators.quality import report

    for name, df in report(runs, sources).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


ELEMENT = "page_id long, ord int, tag string, role string, text string, href string, name string, input_type string, autocomplete string, placeholder string, container string"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "title", "meta", "html", "body"}
CONTAINERS = ("restricted", "classified", "confidential")


def role_of(tag: str, a: dict[str, str]) -> str:
    """What a visitor can do with an element."""
    kind, role = a.get("type", "").lower(), a.get("role", "").lower()
    if tag == "input":
        if kind in ("submit", "button"):
            return "button"
        if kind == "search" or role == "searchbox":
            return "input:search"
        for x in ("checkbox", "radio"):
            if x in (kind, role):
                return x
        return f"input:{kind or 'text'}"
    for name, tags, roles in (("button", "button", "button"), ("link", "a", "link"), ("select", "select", ""), ("textarea", "textarea", "")):
        if tag == tags or roles and role == roles:
            return name
    if role == "combobox" or a.get("aria-haspopup") == "listbox":
        return "combobox"
    if role in ("checkbox", "switch"):
        return "checkbox"
    if role == "radio":
        return role
    if role in ("textbox", "searchbox") or a.get("contenteditable") == "true" or "message" in (a.get("aria-label", "") + a.get("placeholder", "")).lower():
        return "editable"
    return "clickable" if role in ("tab", "listitem", "row", "gridcell") else "text"


class Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows, self.open = [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        marked = f"{a.get('class', '')} {a.get('id', '')}".lower()
        inside = next((c for c in CONTAINERS if c in marked), self.open[-1]["container"] if self.open else None)
        row = {"tag": tag, "role": role_of(tag, a), "parts": [], "href": a.get("href"), "name": a.get("name"), "input_type": a.get("type"), "autocomplete": a.get("autocomplete"), "placeholder": a.get("placeholder"), "container": inside}
        if tag not in SKIPPED:
            self.rows.append(row)
        if tag not in VOID:
            self.open.append(row)

    def handle_endtag(self, tag):
        if any(r["tag"] == tag for r in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] not in SKIPPED:
            self.open[-1]["parts"].append(data)


def page_elements(pages: DataFrame) -> DataFrame:
    """One row for each element of a page: tag, role, own text, link, form attributes and the marked container it is in."""
    ship(pages.sparkSession)
    names = [f.split()[0] for f in ELEMENT.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, html in zip(b["page_id"].to_pylist(), b["html"].to_pylist()):
                p = Elements()
                p.feed(html or "")
                p.close()
                out = {n: [] for n in names}
                for i, r in enumerate(p.rows):
                    r |= {"page_id": page, "ord": i, "text": " ".join("".join(r["parts"]).split())}
                    for n in names:
                        out[n].append(r[n])
                kinds = {"page_id": pa.int64(), "ord": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds.get(n, pa.string())) for n in names], names)

    return pages.select("page_id", "html").mapInArrow(each, ELEMENT)


def safe_labels(elements: DataFrame) -> DataFrame:
    """elements with safe_label: the first of text, placeholder and name that is neither personal data nor an attack."""
    from maskline.operators.discover import has_pii, scan_prompt_injection

    out = elements
    for c in ("text", "placeholder", "name"):
        tidy = F.lower(F.left(F.trim(F.regexp_replace(F.regexp_replace(F.col(c), r"\s+", " "), r"[*:]+\s*$", "")), F.lit(50)))
        out = scan_prompt_injection(has_pii(out.withColumn(f"_{c}", tidy), f"_{c}", f"_{c}_pii"), f"_{c}").withColumn(f"_{c}", F.when((F.col(f"_{c}") != "") & ~F.col(f"_{c}_pii") & ~F.col("is_injection"), F.col(f"_{c}"))).drop("matches", "is_injection", "risk", f"_{c}_pii")
    return out.withColumn("safe_label", F.when(F.col("container").isNull(), F.coalesce("_text", "_placeholder", "_name"))).drop("_text", "_placeholder", "_name")


def classified_containers(elements: DataFrame) -> DataFrame:
    """Everything with text inside a restricted, classified or confidential container."""
    return elements.filter("container is not null and text <> ''")
