"""Tables of web pages: node rows from HTML, and what is read from them by joins and filters."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import content_key, split_notes, version_match
from .dedupe import keep_fullest
from .selectors import nearest, within

NODES = "page_id long, node_id int, last_id int, parent_id int, nth int, xpath string, depth int, tag string, attrs map<string,string>, own_text string, text string, hidden boolean"

#: Elements without content, elements whose content is no text, and elements that stand apart from their neighbours.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style svg noscript template".split())
BLOCK = frozenset("address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section table td th tr ul option label".split())


class _Tree(HTMLParser):
    """Rows of elements, and the visible text of the page as one list of pieces, of which the text of each element is a stretch.

    An end tag closes the nearest open element of its name and all inside it; others are ignored.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parents, self.tags, self.attrs, self.own, self.hidden, self.silent, self.first, self.last = ([] for _ in range(8))
        self.open: list[int] = []
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        style = held.get("style", "").replace(" ", "").lower()
        if tag in BLOCK:
            self.pieces.append(" ")
        self.hidden.append("hidden" in held or "display:none" in style or "visibility:hidden" in style or held.get("aria-hidden") == "true" or (parent >= 0 and self.hidden[parent]))
        self.silent.append(tag in SILENT or (parent >= 0 and self.silent[parent]))
        self.parents.append(parent)
        self.tags.append(tag)
        self.attrs.append(held)
        self.own.append([])
        self.first.append(len(self.pieces))
        self.last.append(None)
        self.open.append(len(self.tags) - 1)
        if tag in VOID:
            self._close(len(self.open) - 1)

    def _close(self, at: int):
        for i in reversed(self.open[at:]):
            self.last[i] = len(self.pieces)
            if self.tags[i] in BLOCK:
                self.pieces.append(" ")
        del self.open[at:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[at]] == tag:
                self._close(at)
                break

    def handle_data(self, data):
        if self.open and not self.silent[self.open[-1]]:
            self.own[self.open[-1]].append(data)
            self.pieces.append(data)


def _flat(parts) -> str:
    return " ".join("".join(parts).split())


def _columns(html: str | None, page_id: int, need: frozenset[str], tags: frozenset[str] | None, cols: dict[str, list]) -> None:
    """Append the elements of a page to the wanted columns."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._close(0)
    keep = [i for i, t in enumerate(tree.tags) if tags is None or t in tags]
    cols["page_id"] += [page_id] * len(keep)
    cols["node_id"] += keep
    last = list(range(len(tree.parents)))
    for i in range(len(last) - 1, -1, -1):
        if tree.parents[i] >= 0:
            last[tree.parents[i]] = max(last[tree.parents[i]], last[i])
    nth, depth, xpath = [], [], []
    if need & {"nth", "depth", "xpath"}:
        seen: dict[tuple[int, str], int] = {}
        for p, t in zip(tree.parents, tree.tags):
            seen[p, t] = seen.get((p, t), 0) + 1
            nth.append(seen[p, t])
            depth.append(depth[p] + 1 if p >= 0 else 0)
        if "xpath" in need:
            for p, t, n in zip(tree.parents, tree.tags, nth):
                xpath.append(f"{xpath[p] if p >= 0 else ''}/{t}[{n}]")
    make = {
        "last_id": lambda i: last[i], "nth": lambda i: nth[i], "xpath": lambda i: xpath[i], "depth": lambda i: depth[i],
        "parent_id": lambda i: tree.parents[i], "tag": lambda i: tree.tags[i], "attrs": lambda i: [*tree.attrs[i].items()], "hidden": lambda i: tree.hidden[i],
        "own_text": lambda i: _flat(tree.own[i]), "text": lambda i: _flat(tree.pieces[tree.first[i] : tree.last[i]]),
    }
    for name in need & make.keys():
        cols[name] += map(make[name], keep)


_KINDS = {"page_id": pa.int64(), "node_id": pa.int32(), "parent_id": pa.int32(), "last_id": pa.int32(), "nth": pa.int32(), "xpath": pa.string(), "depth": pa.int32(), "tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "own_text": pa.string(), "text": pa.string(), "hidden": pa.bool_()}


def page_nodes(pages: DataFrame, need: tuple[str, ...] | None = None, tags: tuple[str, ...] | None = None, dealt: bool = True) -> DataFrame:
    """One row for each element, of the given ``tags`` only if any, with the columns of NODES, besides the ids only ``need`` if given.

    ``node_id`` numbers elements as they start; ``last_id`` is the last one inside, so an element's descendants are the numbers
    after its own up to that one. ``nth`` counts the siblings of one tag, ``xpath`` the way from the root by tags and their ``nth``.

    ``text`` is all visible text below an element: script and style dropped, blocks set apart, entities decoded, white space
    collapsed. Pages are parsed in Arrow batches; columns that nobody needs are not built.

    Nodes are ``dealt`` out by page. Spark takes them to be as few as the bytes of their pages, and by that estimate would broadcast
    what it joins, at any size: once it has measured them it takes no plan with more shuffles than the first one had. So joins of
    dealt nodes are asked to merge. What only counts or filters can do without.
    """
    kinds = dict(x.split() for x in NODES.split(", "))
    names = [n for n in kinds if need is None or n in need or n in ("page_id", "node_id")]
    wanted, only = frozenset(names), frozenset(tags) if tags else None

    def run(batches):
        for b in batches:
            ids, htmls = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at in range(0, len(ids), 64):
                cols = {n: [] for n in names}
                for page_id, html in zip(ids[at : at + 64], htmls[at : at + 64]):
                    _columns(html, page_id, wanted, only, cols)
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], _KINDS[n]) for n in names], names)

    nodes = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))
    return nodes.repartition("page_id").hint("merge") if dealt else nodes


def page_text(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id = -1").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ").alias("text"))


def page_title(nodes: DataFrame) -> DataFrame:
    """The text of the first title element, else of the first h1."""
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.nullif("text", F.lit(""))), F.when((F.col("tag") == tag) & (F.col("text") != ""), F.col("node_id")))
    return nodes.where(F.col("tag").isin("title", "h1")).groupBy("page_id").agg(F.coalesce(first("title"), first("h1")).alias("title"))


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def page_links(nodes: DataFrame) -> DataFrame:
    """Links and buttons with their text, id, class and href; blank ones are dropped."""
    return nodes.where(F.col("tag").isin("a", "button") & (F.col("text") != "")).select("page_id", "node_id", "tag", "text", _attr("id").alias("element_id"), _attr("class").alias("class"), _attr("href").alias("href"), F.map_filter("attrs", lambda k, _: k.startswith("data-")).alias("data"))


def _inside(nodes: DataFrame, outer: DataFrame, tag: str) -> DataFrame:
    """Nodes with the nearest ancestor of the given tag as ``<tag>_id``."""
    return nearest(nodes, outer.where(F.col("tag") == tag), f"{tag}_id")


def page_tables(nodes: DataFrame) -> DataFrame:
    """(page_id, table_id, row, cell, is_header, text, row_attrs): the cells of every table, rows and cells from 0."""
    rows = _inside(nodes.where("tag = 'tr'"), nodes, "table").select("page_id", "table_id", F.col("node_id").alias("tr_id"), F.col("attrs").alias("row_attrs"))
    rows = rows.withColumn("row", F.row_number().over(Window.partitionBy("page_id", "table_id").orderBy("tr_id")) - 1)
    cells = _inside(nodes.where(F.col("tag").isin("td", "th")), nodes, "tr").select("page_id", "tr_id", "node_id", "tag", "text")
    cells = cells.withColumn("cell", F.row_number().over(Window.partitionBy("page_id", "tr_id").orderBy("node_id")) - 1)
    return cells.join(rows, ["page_id", "tr_id"]).select("page_id", "table_id", "row", "cell", (F.col("tag") == "th").alias("is_header"), "text", "node_id", "row_attrs")


#: The headings of a table of version requirements.
VERSION, CONTENT, NOTES = "版本", "版本内容", "说明"


def requirement_rows(nodes: DataFrame, version: str, media: str | None = None) -> DataFrame:
    """(page_id, table_id, row, version, content, notes, version_match) of the rows for a version in tables with the three headings; one row for each content, the fullest."""
    cells = page_tables(nodes)
    heads = cells.where("row = 0").groupBy("page_id", "table_id").agg(F.collect_set("text").alias("heads"))
    good = heads.where(F.size(F.array_except(F.array(*[F.lit(h) for h in (VERSION, CONTENT, NOTES)]), "heads")) == 0).select("page_id", "table_id")
    body = cells.where("row > 0 and not is_header").join(good, ["page_id", "table_id"])
    items = _inside(nodes.where("tag = 'li'"), nodes, "td").groupBy("page_id", F.col("td_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_id").alias("at"), "text"))), lambda x: x["text"]).alias("items"))
    body = body.join(items, ["page_id", "node_id"], "left")
    at = lambda i, c="text": F.max(F.when(F.col("cell") == i, F.col(c)))
    row_media = F.coalesce(*[F.try_element_at("row_attrs", F.lit(k)) for k in ("data-page-requirements-media", "data-flow-media", "data-media")], F.lit(""))
    rows = body.withColumn("media", row_media).groupBy("page_id", "table_id", "row").agg(at(0).alias("version"), at(1).alias("content"), at(2).alias("note_text"), F.max_by("items", F.when(F.col("cell") == 2, 1)).alias("items"), F.max("media").alias("media"))
    rows = rows.where("version <> '' and content <> '' and note_text <> ''").withColumn("version_match", version_match(F.col("version"), version)).where("version_match <> 'excluded'")
    if media:
        rows = rows.where((F.col("media") == "") | (F.col("media") == media))
    rows = rows.select("page_id", "table_id", "row", "version", "content", F.coalesce("items", split_notes(F.col("note_text"))).alias("notes"), "version_match")
    return keep_fullest(rows.withColumn("key", content_key(F.col("content"))), ["page_id", "key"], F.length(F.array_join("notes", "")), ["table_id", "row"]).drop("key", "n_copies")


def merge_requirements(rows: DataFrame) -> DataFrame:
    """Requirements of several pages as one table: the fullest of each content, with the pages of the others."""
    keyed = rows.withColumn("key", content_key(F.col("content")))
    return keep_fullest(keyed, ["key"], F.length(F.array_join("notes", "")), ["page_id", "table_id", "row"], "page_id").withColumnRenamed("other_sources", "other_pages")


def page_notes(nodes: DataFrame, keywords=("note", "tip", "remark", "hint")) -> DataFrame:
    """Texts of elements whose class holds a keyword, with the nearest heading before them; of equal texts in a page the last."""
    heading = F.col("tag").rlike("^h[1-6]$") & (F.col("text") != "")
    marked = F.lower(F.coalesce(_attr("class"), F.lit(""))).rlike("|".join(keywords)) & (F.col("text") != "")
    some = nodes.where(heading | marked).select("page_id", "node_id", F.col("text").alias("note"), heading.alias("_head"), marked.alias("_note"))
    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    found = some.withColumn("section", F.last(F.when(F.col("_head"), F.col("note")), ignorenulls=True).over(before)).where("_note").drop("_head", "_note")
    last = Window.partitionBy("page_id", "note").orderBy(F.desc("node_id"))
    return found.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def page_fields(nodes: DataFrame) -> DataFrame:
    """Form controls with their name: the label that points to them, else placeholder, else name; the last of a name in a page."""
    controls = nodes.where(F.col("tag").isin("input", "select", "textarea")).select("page_id", "node_id", "tag", _attr("type").alias("type"), _attr("id").alias("element_id"), F.coalesce(_attr("placeholder"), _attr("name")).alias("_own"))
    labels = nodes.where("tag = 'label'").select("page_id", _attr("for").alias("element_id"), F.col("text").alias("_label")).where("element_id is not null").dropDuplicates(["page_id", "element_id"])
    named = controls.join(labels, ["page_id", "element_id"], "left").withColumn("name", F.coalesce(F.nullif("_label", F.lit("")), "_own")).where("name is not null").drop("_own", "_label")
    last = Window.partitionBy("page_id", "name").orderBy(F.desc("node_id"))
    return named.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def page_interactions(nodes: DataFrame) -> DataFrame:
    """Dialogs, drawers and popovers with title, number of fields and action texts."""
    boxes = nodes.where(F.lower(F.concat_ws(" ", _attr("class"), _attr("role"))).rlike("dialog|drawer|popover|modal")).select("page_id", "node_id", "last_id", _attr("class").alias("class"))
    i = nodes.where(F.col("tag").rlike("^(h[1-6]|input|select|textarea|button)$")).select("page_id", "node_id", "tag", "text").alias("i")
    pairs = boxes.alias("o").join(i, within("i", "o"), "left")
    inner = pairs.select("o.page_id", F.col("o.node_id").alias("box"), "o.class", "i.node_id", "i.tag", "i.text", (F.col("o.last_id") > F.col("o.node_id")).alias("filled")).where("filled")
    title = F.min_by(F.when(F.col("tag").rlike("^h[1-6]$"), F.col("text")), F.when(F.col("tag").rlike("^h[1-6]$"), F.col("node_id")))
    return inner.groupBy("page_id", "box", "class").agg(title.alias("title"), F.count_if(F.col("tag").isin("input", "select", "textarea")).alias("n_fields"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == "button") & (F.col("text") != ""), F.struct("node_id", "text")))), lambda x: x["text"]), ",").alias("actions"))


def interaction_warnings(nodes: DataFrame) -> DataFrame:
    """(page_id, n_triggers): pages with elements that open a dialog of which none was found."""
    attr = lambda n: F.lower(F.coalesce(_attr(n), F.lit("")))
    trigger = attr("aria-haspopup").isin("dialog", "true") | (attr("data-toggle") == "modal") | (F.col("tag").isin("a", "button") & F.lower(F.concat_ws(" ", _attr("class"), "text")).rlike("dialog|modal|popup|drawer|弹窗|抽屉"))
    box = F.lower(F.concat_ws(" ", _attr("class"), _attr("role"))).rlike("dialog|drawer|popover|modal") & ~F.col("tag").isin("a", "button")
    return nodes.groupBy("page_id").agg(F.count_if(trigger & ~box).alias("n_triggers"), F.count_if(box).alias("_boxes")).where("n_triggers > 0 and _boxes = 0").drop("_boxes")


def page_url_parts(pages: DataFrame) -> DataFrame:
    """Host, path, query parameters and base url of each page."""
    bare = F.regexp_replace("url", "#.*$", "")
    params = F.coalesce(F.str_to_map(F.parse_url(bare, F.lit("QUERY")), F.lit("&"), F.lit("=")), F.create_map().cast("map<string,string>"))
    return pages.select("page_id", F.parse_url(bare, F.lit("HOST")).alias("host"), F.parse_url(bare, F.lit("PATH")).alias("path"), params.alias("params"), F.regexp_replace(bare, r"\?.*$", "").alias("base_url"))


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, node_id, target_url, target_page): hrefs made absolute and looked up among the known pages; fragments do not count."""
    base = pages.select("page_id", F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1).alias("_root"), F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"[^/]*$", "").alias("_dir"))
    href = F.regexp_replace("href", "#.*$", "")
    joined = links.where("href is not null").join(base, "page_id")
    scheme = F.concat(F.regexp_extract("_root", "^([a-z]+:)", 1), href)
    # The path without its query is walked step by step; a .. at the top has nowhere to go, as in a browser.
    steps = F.split(F.regexp_replace(F.substring(F.concat("_dir", F.regexp_replace(href, r"\?.*$", "")), F.length("_root") + 1, F.lit(1 << 30)), "^/", ""), "/")
    walk = F.aggregate(F.transform(steps, lambda x, i: F.struct(x.alias("x"), (i == F.size(steps) - 1).alias("last"))), F.array().cast("array<string>"), lambda at, s: F.when(s["x"].isin(".", ".."), F.concat(F.when(s["x"] == ".", at).otherwise(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))), F.when(s["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).otherwise(F.concat(at, F.array(s["x"]))))
    joined_path = F.concat("_root", F.lit("/"), F.array_join(walk, "/"), F.regexp_extract(href, r"\?.*$", 0))
    target = F.when(href.rlike("^[a-z]+://"), href).when(href.startswith("//"), scheme).when(href.startswith("/"), F.concat("_root", href)).otherwise(joined_path)
    known = pages.select(F.regexp_replace("url", "#.*$", "").alias("target_url"), F.col("page_id").alias("target_page")).groupBy("target_url").agg(F.min("target_page").alias("target_page"))
    return joined.select("page_id", "node_id", target.alias("target_url")).join(known, "target_url", "left").select("page_id", "node_id", "target_url", "target_page")


def page_stats(nodes: DataFrame) -> DataFrame:
    """Elements, links, buttons, tables, fields and headings of each page."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    t = F.col("tag")
    return nodes.groupBy("page_id").agg(F.count("*").alias("n_nodes"), n(t == "a", "n_links"), n(t == "button", "n_buttons"), n(t == "table", "n_tables"), n(t.isin("input", "select", "textarea"), "n_fields"), n(t.rlike("^h[1-6]$"), "n_headings"))


def page_summary(nodes: DataFrame, requirements: DataFrame, notes: DataFrame, interactions: DataFrame) -> DataFrame:
    """``page_stats`` of each page with its numbers of requirements, notes and interactions."""
    out = page_stats(nodes)
    for df, name in ((requirements, "n_requirements"), (notes, "n_notes"), (interactions, "n_interactions")):
        out = out.join(df.groupBy("page_id").agg(F.count("*").alias(name)), "page_id", "left")
    return out.na.fill(0)
