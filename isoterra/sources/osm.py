"""Squares of nodes, ways and relations as XML files, plain or xz; change files; answers of a map server."""

from __future__ import annotations

import io
import lzma
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MEMBER = "struct<type:string,ref:bigint,role:string>"
ELEMENT = f"square string, kind string, op string, id bigint, lat double, lon double, refs array<bigint>, members array<{MEMBER}>, tags map<string,string>, version int, file_pos int"
XZ = b"\xfd7zXZ\x00"
_NAME = re.compile(r"([NS]\d{2}[EW]\d{3})\.[^/]*$")


def opened(data: bytes) -> io.BufferedIOBase:
    """The XML of a file's bytes: xz is told by its first bytes, not by the file's name."""
    return lzma.open(io.BytesIO(data)) if data.startswith(XZ) else io.BytesIO(data)


def elements(data: bytes, square: str | None) -> Iterator[tuple]:
    """Rows of ELEMENT in file order. In a change file op is create, modify or delete, else null."""
    op, place, root = None, 0, None
    for event, e in ET.iterparse(opened(data), events=("start", "end")):
        if event == "start":
            root = e if root is None else root
            op = e.tag if e.tag in ("create", "modify", "delete") else op
            continue
        if e.tag in ("create", "modify", "delete"):
            op = None
        if e.tag not in ("node", "way", "relation"):
            continue
        get = e.attrib.get
        yield (
            square, e.tag, op, int(get("id")), float(get("lat")) if get("lat") else None, float(get("lon")) if get("lon") else None,
            [int(n.get("ref")) for n in e.iter("nd")] if e.tag == "way" else None,
            [(m.get("type"), int(m.get("ref")), m.get("role") or "") for m in e.iter("member")] if e.tag == "relation" else None,
            {t.get("k"): t.get("v") for t in e.iter("tag")}, int(get("version")) if get("version") else None, place,
        )
        place += 1
        e.clear()
        if root is not None and len(root) > 1000:
            root.clear()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in re.sub(r"<[^()]*?>+", "", ELEMENT).split(", ")]
    for b in batches:
        for path, content in zip(b["path"], b["content"], strict=True):
            m = _NAME.search(path)
            rows = []
            for row in elements(bytes(content), m[1] if m else None):
                rows.append(row)
                if len(rows) == 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def read_elements(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every element of the square or change files. A file is a task's work; the largest are streamed in pieces."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_parse, ELEMENT)


def nodes(e: DataFrame) -> DataFrame:
    return e.where("kind = 'node'").select("square", "id", "lat", "lon", "tags", "version", "file_pos")


def ways(e: DataFrame) -> DataFrame:
    return e.where("kind = 'way'").select("square", "id", "refs", "tags", "version", "file_pos")


def relations(e: DataFrame) -> DataFrame:
    return e.where("kind = 'relation'").select("square", "id", "members", "tags", "version", "file_pos")


def way_nodes(way: DataFrame) -> DataFrame:
    return way.select("square", F.col("id").alias("way_id"), F.posexplode("refs").alias("seq", "node_id"))


def coords(way: DataFrame, node: DataFrame) -> DataFrame:
    """Points of ways in order; a reference to a node that is not there is passed over."""
    n = node.select("square", F.col("id").alias("node_id"), "lat", "lon")
    return way_nodes(way).join(n, ["square", "node_id"])


def _element_xml(r) -> str:
    place = "" if r.lat is None or pd.isna(r.lat) else f" lat={quoteattr(repr(float(r.lat)))} lon={quoteattr(repr(float(r.lon)))}"
    version = "" if r.version is None or pd.isna(r.version) else f' version="{int(r.version)}"'
    tags = r.tags if isinstance(r.tags, dict) else dict(r.tags) if r.tags is not None else {}
    inner = [f'<nd ref="{int(x)}"/>' for x in (r.refs if r.refs is not None else [])]
    inner += [f"<member type={quoteattr(m['type'])} ref=\"{int(m['ref'])}\" role={quoteattr(m['role'])}/>" for m in (r.members if r.members is not None else [])]
    inner += [f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in sorted(tags.items())]
    head = f'  <{r.kind} id="{int(r.id)}"{place}{version}'
    return head + ("/>" if not inner else ">\n" + "".join(f"    {x}\n" for x in inner) + f"  </{r.kind}>")


def _text(rows: pd.DataFrame) -> pd.DataFrame:
    rank = rows["kind"].map({"node": 0, "way": 1, "relation": 2})
    rows = rows.assign(_rank=rank).sort_values(["_rank", "file_pos", "id"], kind="stable")
    body = "\n".join(_element_xml(r) for r in rows.itertuples())
    text = '<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6">\n' + body + ("\n" if len(rows) else "") + "</osm>\n"
    return pd.DataFrame({"square": [rows["square"].iloc[0]], "text": [text]})


def square_texts(e: DataFrame) -> DataFrame:
    """square, text: the same XML for the same elements, nodes before ways before relations, each in file order."""
    return e.groupBy("square").applyInPandas(_text, "square string, text string")


def _change(rows: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for op in ("create", "modify", "delete"):
        some = rows[rows["op"] == op].sort_values("file_pos", kind="stable")
        if len(some):
            parts.append(f" <{op}>\n" + "\n".join(_element_xml(r) for r in some.itertuples()) + f"\n </{op}>\n")
    return pd.DataFrame({"square": [rows["square"].iloc[0]], "text": ['<?xml version="1.0" encoding="UTF-8"?>\n<osmChange version="0.6">\n' + "".join(parts) + "</osmChange>\n"]})


def change_texts(e: DataFrame) -> DataFrame:
    return e.where("op is not null").groupBy("square").applyInPandas(_change, "square string, text string")


ANSWER = "remark string, elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"


def answer_elements(texts: DataFrame) -> DataFrame:
    """type, id, lat, lon, nodes, tags of a map server's JSON answers; an answer cut short by an error stops the query."""
    a = texts.select(F.from_json("value", ANSWER).alias("a"))
    whole = F.when(F.coalesce(F.col("a.remark"), F.lit("")).contains("runtime error"), F.raise_error(F.concat(F.lit("incomplete answer: "), F.col("a.remark")))).otherwise(F.col("a.elements"))
    return a.select(F.explode(whole).alias("e")).select("e.*")


def territories(texts: DataFrame) -> DataFrame:
    """rel, ring, seq, lon, lat of territory polygons (JSON: rel, rings of [lat, lon]); rings under three points drop."""
    t = texts.select(F.from_json("value", "rel bigint, rings array<array<array<double>>>").alias("t")).select("t.rel", F.posexplode("t.rings").alias("ring", "points"))
    good = t.where(F.size("points") >= 3).where(F.forall("points", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()))
    return good.select("rel", "ring", F.posexplode("points").alias("seq", "p")).select("rel", "ring", "seq", F.col("p")[1].alias("lon"), F.col("p")[0].alias("lat"))
