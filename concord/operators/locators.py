"""Elements of pages, how to find them again, and which way is stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import snake_case
from .dedupe import suffix_duplicates
from .selectors import class_names, inside, matches, nearest

#: Roles of elements by tag, and tags and roles that take input.
TAG_ROLES = {"a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "option": "option", "nav": "navigation", "img": "img", "table": "table", "li": "listitem"}
INTERACTIVE_TAGS = ("a", "area", "button", "details", "input", "label", "option", "select", "summary", "textarea")
INTERACTIVE_ROLES = ("button", "checkbox", "combobox", "link", "listbox", "menuitem", "option", "radio", "searchbox", "slider", "spinbutton", "switch", "tab", "textbox", "treeitem")
#: Words that mark the shell of a page, and its pagination.
SHELL = ("menu", "nav", "sidebar", "sider", "header", "topbar", "breadcrumb", "avatar", "profile")
PAGINATION = ("pagination", "pager", "jumper", "btn-prev", "btn-next", "page-size")
#: Strategies by preference, best first; a scoped one is a tag and class inside an ancestor with an id.
STRATEGIES = ("test_id", "id", "role", "label", "placeholder", "text", "name", "css", "scoped", "xpath", "class")


def _attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def page_elements(nodes: DataFrame) -> DataFrame:
    """Nodes with ``role``, accessible ``name`` and the ``reasons`` for which they take input (none: not interactive)."""
    by_tag = F.try_element_at(F.create_map(*[F.lit(x) for kv in TAG_ROLES.items() for x in kv]), F.col("tag"))
    kind = F.lower(F.coalesce(_attr("type"), F.lit("text")))
    by_type = F.when(F.col("tag") == "input", F.when(kind.isin("checkbox", "radio"), kind).when(kind.isin("button", "submit", "reset"), "button").when(kind == "number", "spinbutton").otherwise("textbox"))
    role = F.coalesce(F.nullif(_attr("role"), F.lit("")), by_type, by_tag)
    name = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in (_attr("aria-label"), F.col("text"), _attr("placeholder"), _attr("title"), _attr("alt"), _attr("name"))], F.lit(""))
    rows = nodes.withColumn("role", role).withColumn("name", name)
    reasons = F.array(
        F.when(F.col("tag").isin(*INTERACTIVE_TAGS), F.lit("interactive_tag")),
        F.when(F.col("role").isin(*INTERACTIVE_ROLES), F.lit("interactive_role")),
        F.when((F.col("tag") == "a") & _attr("href").isNotNull(), F.lit("href")),
        F.when(_attr("onclick").isNotNull(), F.lit("click_handler")),
        F.when(_attr("contenteditable").isNotNull(), F.lit("contenteditable")),
        F.when(_attr("tabindex").try_cast("int") >= 0, F.lit("tabindex")),
        F.when(F.regexp_replace(F.lower(F.coalesce(_attr("style"), F.lit(""))), " ", "").contains("cursor:pointer"), F.lit("cursor_pointer")),
    )
    return rows.withColumn("reasons", F.filter(reasons, lambda x: x.isNotNull()))


def business_elements(elements: DataFrame) -> DataFrame:
    """Visible interactive elements with ``business_type``; those inside the shell or the pagination of a page are left out."""
    words = F.lower(F.concat_ws(" ", "tag", _attr("class"), _attr("id"), _attr("role")))
    outside = elements.where(words.rlike("|".join([*SHELL, *PAGINATION])) & ~F.col("tag").isin("html", "body", "head")).select("page_id", "node_id", "last_id")
    shell = inside(elements, outside)
    in_table = inside(elements, elements.where("tag = 'table'")).withColumn("_in_table", F.lit(True))
    wanted = elements.where(((F.size("reasons") > 0) | (F.col("tag") == "th")) & ~F.col("hidden")).join(shell, ["page_id", "node_id"], "left_anti").join(in_table, ["page_id", "node_id"], "left")
    kind = F.lower(F.coalesce(_attr("type"), F.lit("")))
    cls = F.lower(F.coalesce(_attr("class"), F.lit("")))
    button = (F.col("tag") == "button") | kind.isin("button", "submit", "reset")
    business = F.when(F.col("tag") == "th", "table_column").when(button & F.col("_in_table"), "table_action").when(button, "action_button").when(F.col("tag") == "a", "link_action").when(F.col("role") == "checkbox", "checkbox").when(F.col("role") == "radio", "radio").when(F.col("role") == "spinbutton", "number_input").when(cls.contains("cascader"), "cascader").when((F.col("role") == "combobox") | cls.contains("select"), "select").when(cls.rlike("date|picker"), "date_input").when(F.col("tag") == "textarea", "textarea").otherwise("text_input")
    return wanted.withColumn("business_type", business).drop("_in_table")


def is_dynamic_id(c: Column) -> Column:
    """Ids that a framework numbers anew, or that end in a long number. The framework's forms."""
    return F.coalesce(c, F.lit("")).rlike(r"^el-id-\d+-\d+$|[0-9]{5,}$|^:r[0-9a-z]+:$")


def is_generic_class(c: Column) -> Column:
    """No class but those of a framework or of a state. Their names."""
    names = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: (x != "") & ~x.startswith("el-") & ~x.isin("is-link", "is-active", "is-disabled", "is-focus"))
    return F.size(names) == 0


def _classes(c: Column) -> Column:
    """The classes that say something of an element."""
    return F.filter(class_names(c), lambda x: ~is_generic_class(x))


def element_paths(elements: DataFrame) -> DataFrame:
    """(page_id, node_id, xpath, container): the place of each element by tags and their numbers, and the id of the nearest ancestor that has a steady one."""
    boxes = elements.where(~is_dynamic_id(_attr("id")) & (F.coalesce(_attr("id"), F.lit("")) != ""))
    near = nearest(elements.select("page_id", "node_id"), boxes, "_box")
    named = near.join(boxes.select("page_id", F.col("node_id").alias("_box"), _attr("id").alias("container")), ["page_id", "_box"]).select("page_id", "node_id", "container")
    return elements.select("page_id", "node_id", "xpath").join(named, ["page_id", "node_id"], "left")


def locator_candidates(elements: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(page_id, node_id, strategy, value, unique, priority) of each element. ``unique``: it alone in its page (in ``scope``, if given) is what the locator matches.

    Values of attributes and texts match what has the same; selectors by class match every element that has the classes, with
    others too, and scoped ones all such elements anywhere below the container. xpath and scoped need ``scope``, all elements of
    the pages.
    """
    def stacked(df: DataFrame) -> DataFrame:
        named = F.array_join(F.concat(F.array(F.col("tag")), F.col("_classes")), ".")
        pairs = [("test_id", F.coalesce(_attr("data-testid"), _attr("data-test"))), ("id", _attr("id")), ("role", F.when((F.col("name") != "") & F.col("role").isNotNull(), F.concat_ws("|", "role", "name"))), ("label", _attr("aria-label")), ("placeholder", _attr("placeholder")), ("text", F.nullif("text", F.lit(""))), ("name", _attr("name")), ("css", F.when(_attr("href").isNotNull(), F.concat(F.col("tag"), F.lit('[href="'), _attr("href"), F.lit('"]')))), ("class", F.when(F.size("_classes") > 0, named))]
        if scope is not None:
            pairs += [("xpath", F.col("xpath")), ("scoped", F.when(F.col("container").isNotNull(), F.concat(F.lit("#"), F.col("container"), F.lit(" "), named)))]
        rows = F.filter(F.array(*[F.struct(F.lit(s).alias("strategy"), v.alias("value")) for s, v in pairs]), lambda x: x["value"].isNotNull() & (x["value"] != ""))
        return df.select("page_id", "node_id", "tag", "_classes", *(["container"] if scope is not None else []), F.inline(rows))

    every = elements
    if scope is not None:
        places = element_paths(scope).withColumnRenamed("xpath", "_xpath")
        elements, every = (df.drop("xpath").join(places, ["page_id", "node_id"]).withColumnRenamed("_xpath", "xpath") for df in (elements, scope))
    own = stacked(elements.withColumn("_classes", _classes(_attr("class"))))
    selected = F.col("strategy").isin("class", "scoped")
    plain = stacked(every.withColumn("_classes", _classes(_attr("class")))).where(~selected).groupBy("page_id", "strategy", "value").agg(F.count("*").alias("_n"))
    container = F.when(F.col("strategy") == "scoped", F.col("container")) if scope is not None else F.lit(None).cast("string")
    asked = own.where(selected).select(F.concat_ws(" ", "strategy", "value").alias("selector"), "page_id", container.alias("container"), "tag", F.col("_classes").alias("classes")).distinct()
    met = matches(asked, every).groupBy("page_id", "selector").agg(F.count("*").alias("_n"))
    counts = plain.unionByName(met.select("page_id", F.substring_index("selector", " ", 1).alias("strategy"), F.expr("substring(selector, instr(selector, ' ') + 1)").alias("value"), "_n"))
    rank = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    return own.join(counts, ["page_id", "strategy", "value"]).select("page_id", "node_id", "strategy", "value", (F.col("_n") == 1).alias("unique"), rank.cast("int").alias("priority"))


def locator_strategies(candidates: DataFrame) -> DataFrame:
    """Candidates fit for use: no dynamic ids, and none but unique ones."""
    return candidates.where("unique").where(~((F.col("strategy") == "id") & is_dynamic_id(F.col("value"))))


def rank_locators(candidates: DataFrame) -> DataFrame:
    """The chosen candidate of each element: by preference of strategy, then by value."""
    by = Window.partitionBy("page_id", "node_id").orderBy("priority", F.length("value"), "value")
    return candidates.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


#: Words for usual labels, and prefixes of names that say nothing.
PHRASES = {"ok": "confirm", "确定": "confirm", "cancel": "cancel", "取消": "cancel", "search": "search", "查询": "search", "save": "save", "保存": "save", "delete": "delete", "删除": "delete"}
GENERIC = ("please_enter_", "please_select_", "enter_", "select_", "click_to_")


def element_names(elements: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``unique_name`` in snake case from type and name, numbered where it repeats in a page, and the ``keywords`` to search by.

    A name that ``phrases`` knows takes its word; prefixes that say nothing are cut.
    """
    word = F.try_element_at(F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv]), F.lower(F.trim("name"))) if phrases else F.lit(None).cast("string")
    plain = F.regexp_replace(snake_case(F.col("name")), "^(" + "|".join(GENERIC) + ")", "")
    base = F.concat_ws("_", "business_type", F.nullif(F.coalesce(word, plain), F.lit("")))
    named = elements.withColumn("base_name", F.concat_ws("/", "page_id", base))
    out = suffix_duplicates(named, "base_name", ["node_id"])
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "name", "business_type")), r"[\s_]+"), lambda x: x != ""))
    return out.withColumn("unique_name", F.regexp_replace("unique_name", r"^[^/]*/", "")).withColumn("keywords", words).drop("base_name")


def locator_stability(states: DataFrame) -> DataFrame:
    """(element, strategy, value, status, chosen, risks) from ``states(element, state, strategy, value, unique, visible, operable)``.

    PASS: unique, visible and operable in all captured states of the element; WARN: in some; FAIL: in none; BLOCKED: never
    captured. The best passing strategy is chosen.
    """
    ok = F.col("unique") & F.col("visible") & F.col("operable")
    all_states = states.groupBy("element").agg(F.count_distinct("state").alias("_states"))
    per = states.groupBy("element", "strategy", "value").agg(F.count_distinct(F.when(ok, F.col("state"))).alias("_ok"), F.count("unique").alias("_seen"), F.bool_or(~F.col("unique")).alias("_dup")).join(all_states, "element")
    status = F.when(F.col("_seen") == 0, "BLOCKED").when(F.col("_ok") == F.col("_states"), "PASS").when(F.col("_ok") > 0, "WARN").otherwise("FAIL")
    risks = F.array_join(F.filter(F.array(F.when((F.col("strategy") == "text") & F.col("_dup"), F.lit("text-duplicate-risk")), F.when((F.col("strategy") == "id") & is_dynamic_id(F.col("value")), F.lit("dynamic-attribute")), F.when((F.col("_ok") > 0) & (F.col("_ok") < F.col("_states")), F.lit("state-dependent")), F.when(F.col("strategy").isin("text", "label", "placeholder"), F.lit("i18n-sensitive")), F.when(F.col("strategy").isin("css", "xpath", "class"), F.lit("fragile"))), lambda x: x.isNotNull()), ",")
    rated = per.withColumn("status", status).withColumn("risks", risks).withColumn("_rank", F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy")))
    first = Window.partitionBy("element").orderBy(F.when(F.col("status") == "PASS", 0).otherwise(1), "_rank", "value")
    return rated.withColumn("chosen", (F.row_number().over(first) == 1) & (F.col("status") == "PASS")).select("element", "strategy", "value", "status", "chosen", "risks")


def locator_summary(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASS", "WARN", "FAIL", "BLOCKED")])
