"""Questions to a finished graph: what is visible, near, connected, central or named alike.

All functions read the long form: ``edges`` is ``edge_relations(..)``, one row per relation, and
``nodes`` is ``entity_nodes(..)``.  Sets of neighbours, edges or supporting relations come back as
rows, because a hub or a pair of large tables has too many for an array.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.functions.labels import business_name, confidence_band, relation_type_label, relation_visible
from relweave.functions.text import search_norm, strip_to_null
from relweave.functions.identity import edge_id
from relweave.operators.graph import ENDS, distinct_ends, edge_ends, side_by_side, with_edge_id
from relweave.operators.ranking import grouped_row_number
from relweave.session import Stored, buckets_of, dealt, dealt_like, materialize

TOP_HUBS = 24
STRONG_WEIGHT, WEAK_WEIGHT = 1.0, 0.35
LABEL_SEPARATOR = " · "

# What is shown for a table edge whose support cannot be resolved, and for lone nodes.
MIXED_LABEL = "相关"
NO_NEIGHBOUR = ("暂无相邻对象", "等待更多关系")
MISSING_SUPPORT = "支撑关系不可用"
UNNAMED = "未命名对象"


def visible_relations(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.where(relation_visible(F.col("strength"), F.col("confidence"), threshold))


def visible_edges(edges: DataFrame, threshold: float) -> DataFrame:
    """Edges with a visible relation, with how many are visible."""
    seen = dealt(visible_relations(edges, threshold).select(*ENDS), ENDS, edges)
    counted = seen.groupBy(*ENDS).agg(F.count(F.lit(1)).alias("visible_count"))
    return with_edge_id(counted).select("edge_id", *ENDS, "visible_count")


def project_graph(nodes: DataFrame, edges: DataFrame, show_isolated: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without dangling edges and, unless shown, without isolated nodes."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "edge_source"), "edge_source", "left_semi").join(
        ids.withColumnRenamed("id", "edge_target"), "edge_target", "left_semi"
    )
    if show_isolated:
        return nodes, kept
    return nodes.join(_end_ids(kept), "id", "left_semi"), kept


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes of ``project_graph`` without isolated ones.  Most often no edge dangles, and only the distinct ends of edges are moved."""
    ends = materialize(_end_ids(edges), "ends")
    return nodes.join(ends, "id", "left_semi") if _all_known(nodes, ends) else project_graph(nodes, edges, False)[0]


def _end_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(*ENDS)).alias("id")).distinct()


def isolated_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many nodes there are and how many of them have no edge."""
    connected = connected_nodes(nodes, edges)
    total = nodes.agg(F.count(F.lit(1)).alias("node_count"))
    joined = connected.agg(F.count(F.lit(1)).alias("connected_count"))
    return side_by_side(total, joined).select("node_count", (F.col("node_count") - F.col("connected_count")).alias("isolated_count"))


def neighbor_union(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each neighbour once."""
    return _both_ways(distinct_ends(edges), "neighbor")


def _both_ways(ends: DataFrame, far: str, *columns: str) -> DataFrame:
    """Both directions of distinct edges, a loop once."""
    ways = [F.struct(F.col(a).alias("node"), F.col(b).alias(far)) for a, b in (ENDS, ENDS[::-1])]
    return ends.select(F.explode(F.array_distinct(F.array(*ways))).alias("_way"), *columns).select("_way.*", *columns)


def edge_between(node: str, other: str) -> Column:
    """The id of the edge at a node, whichever end the node is."""
    return edge_id("entity", F.least(node, other), F.greatest(node, other))


def adjacency_index(edges: DataFrame, threshold: float) -> DataFrame:
    """(node, neighbour, edge) over visible edges, in long form."""
    return _both_ways(edge_ends(visible_relations(edges, threshold)), "neighbor", "edge_id")


def adjacency_by_node(edges: DataFrame, threshold: float) -> DataFrame:
    """``adjacency_index`` dealt by node: relations move once, both ways, and joins and groups by node move them no more."""
    ways = _both_ways(visible_relations(edges, threshold).select(*ENDS), "neighbor")
    return dealt(ways, ("node",), edges, edges, joined=True).distinct().withColumn("edge_id", edge_between("node", "neighbor"))


def one_hop_focus(adjacency: DataFrame, selections: DataFrame) -> DataFrame:
    """Nodes in focus for each selection (hovered_id, selected_id): the active node and its neighbours.

    With many selections, an adjacency that is dealt by node saves moving it for the join.
    """
    active = selections.select(F.coalesce("hovered_id", "selected_id").alias("active_id")).where("active_id is not null").distinct()
    near = adjacency.select(F.col("node").alias("active_id"), F.col("neighbor").alias("node_id"))
    neighbors = near.join(active, "active_id", "left_semi").withColumn("edge_id", edge_between("active_id", "node_id"))
    return active.select("active_id", F.col("active_id").alias("node_id"), F.lit(None).cast("string").alias("edge_id")).union(neighbors)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges per node: zero for isolated nodes, a loop counts once, dangling edges do not count."""
    return degrees_of(nodes, distinct_ends(edges))


def degrees_of(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``degrees`` from the distinct ends of edges.

    Most often no edge dangles, and what is counted at the ends is right; edges are only looked up by their ends when one does.
    """
    counts = materialize(_edges_at(ends), "degrees")
    if not _all_known(nodes, counts):
        counts = _edges_at(project_graph(nodes, ends, True)[1])
    return nodes.select("id", "table_id").join(counts, "id", "left").na.fill(0, ["degree"])


def _edges_at(ends: DataFrame) -> DataFrame:
    """Edges at each end: id, degree; a loop counts once."""
    each = ends.select(F.explode(F.array_distinct(F.array(*ENDS))).alias("id"))
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def _all_known(nodes: DataFrame, ends: DataFrame) -> bool:
    """Whether every one of the ids is that of a node."""
    return ends.select("id").join(nodes.select("id"), "id", "left_anti").isEmpty()


def legacy_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ends per node over merged edges (source, target); a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["degree"])


def hub_nodes(node_degrees: DataFrame, top: int = TOP_HUBS) -> DataFrame:
    """The best connected node of each table and the best connected ones overall."""
    connected = node_degrees.where("degree > 0").select("table_id", "id", "degree")
    # An aggregate instead of a window: each map task keeps one node per table.
    best = F.min(F.struct((-F.col("degree")).alias("rank"), "id", "degree"))
    per_table = connected.groupBy("table_id").agg(best.alias("b")).select("table_id", "b.id", "b.degree")
    overall = connected.orderBy(F.desc("degree"), "id").limit(top)
    return per_table.union(overall).distinct()


def named_nodes(nodes: DataFrame) -> DataFrame:
    """Name and distinguishing second line of every node.

    Nodes whose names are equal after normalisation show their code, or their number in id order among
    all nodes of that name.  Only names that some node shows with a number are numbered.
    """
    named = nodes.select(
        "id",
        "table_id",
        "class_name",
        business_name(F.try_element_at(F.col("dimensions"), F.lit("name")), F.col("display_name"), F.col("display_name_source")).alias("primary"),
        strip_to_null(F.col("display_code")).alias("code"),
    )
    keyed = named.withColumn("name_key", search_norm(F.col("primary")))
    sizes = keyed.groupBy("name_key").agg(F.count(F.lit(1)).alias("name_count"), F.count_if(F.col("code").isNull()).alias("bare"))
    sized = keyed.join(sizes, "name_key")
    numbers = grouped_row_number(sized.where("name_count > 1 AND bare > 0").select("id", "name_key", "code"), ["name_key"], "id", "number")
    numbered = sized.join(numbers.where("code IS NULL").select("id", "number"), "id", "left")
    is_duplicate = F.col("name_count") > 1
    secondary = F.when(
        is_duplicate, F.coalesce("code", F.concat(F.lit("同名 "), F.col("number").cast("string")))
    ).otherwise(F.lit(""))
    return numbered.select(
        "id",
        "table_id",
        "class_name",
        "primary",
        secondary.alias("secondary"),
        search_norm(F.concat_ws(" ", "primary", F.nullif(secondary, F.lit("")))).alias("search_text"),
        is_duplicate.alias("is_duplicate"),
    )


def presentations(nodes: DataFrame, node_degrees: DataFrame) -> DataFrame:
    """Names, second lines and spoken labels, which tell the number of relations, of every node."""
    shown = named_nodes(nodes).join(node_degrees.select("id", "degree"), "id", "left")
    relations = F.concat(F.coalesce("degree", F.lit(0)).cast("string"), F.lit(" 个关系"))
    label = F.concat_ws("；", "primary", F.nullif(F.col("secondary"), F.lit("")), relations)
    return shown.select("id", "table_id", "class_name", "primary", "secondary", label.alias("accessible_label"), "search_text", "is_duplicate")


def search_words(query: str) -> list[str]:
    return unicodedata.normalize("NFKC", query).lower().split()


def searched_text() -> Column:
    """What a search looks at: name, second line, class and id."""
    return search_norm(F.concat_ws(" ", "primary", F.nullif(F.col("secondary"), F.lit("")), F.nullif(F.col("class_name"), F.lit("")), "id"))


def node_search(shown: DataFrame, query: str) -> DataFrame:
    """Nodes whose name, second line, class or id contains any word of the query; none for a blank one.

    This scans all nodes; ``search_index`` answers the same from postings.
    """
    words = search_words(query)
    if not words:
        return shown.limit(0)
    return found_in_order(shown.withColumn("_text", searched_text()), words)


def found_in_order(texts: DataFrame, words: list[str]) -> DataFrame:
    """The nodes whose ``_text`` contains any of the words, by name."""
    any_word = F.lit(False)
    for word in words:
        any_word = any_word | F.contains(F.col("_text"), F.lit(word))
    found = texts.withColumn("_name", search_norm(F.col("primary"))).where(any_word)
    return found.orderBy(F.collate(F.col("_name"), "UNICODE"), F.collate(F.col("id"), "UNICODE")).drop("_text", "_name")


def label_lists(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct business labels per key, sorted and joined.  Each label travels once, dealt by key, and is made distinct there."""
    distinct = dealt(edges.select(*keys, "display_label"), keys, edges).distinct()
    return distinct.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("display_label")), LABEL_SEPARATOR).alias("labels"))


def shared_direction(directions: Column) -> Column:
    """Forward or reverse when all directions agree, else undirected."""
    only = F.when(F.size(directions) == 1, directions[0])
    return (
        F.when(only == "source_to_target", F.lit("forward")).when(only == "target_to_source", F.lit("reverse")).otherwise(F.lit("undirected"))
    )


def edge_directions(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_id").agg(shared_direction(F.collect_set("direction")).alias("direction"))


def edge_weights(edges: DataFrame) -> DataFrame:
    """Layout weight: full for an edge with a strong relation."""
    strong = F.bool_or(F.col("strength") == "strong")
    return edges.groupBy("edge_id").agg(F.when(strong, F.lit(STRONG_WEIGHT)).otherwise(F.lit(WEAK_WEIGHT)).alias("weight"))


def node_detail(edges: DataFrame, shown: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """Edges at the given nodes (all without them), with the other end and the labels."""
    return counted_detail(edges, shown, node_ids).drop("other_rows")


def counted_detail(edges: DataFrame, shown: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """``node_detail`` with ``other_rows``: how many shown nodes have the id of the other end, null for none."""
    rows = _both_ways(label_lists(edges, [*ENDS]), "other", "labels")
    if node_ids is not None:
        rows = rows.join(node_ids.select(F.col("id").alias("node")), "node", "left_semi")
    others = shown.select(
        F.col("id").alias("other"), F.col("primary").alias("other_primary"), F.col("secondary").alias("other_secondary"),
        F.count(F.lit(1)).over(Window.partitionBy("id")).alias("other_rows"),
    )
    return rows.join(others, "other", "left").select(
        "node", "other", F.coalesce("other_primary", F.lit(UNNAMED)).alias("other_primary"),
        F.coalesce("other_secondary", F.lit("")).alias("other_secondary"), edge_between("node", "other").alias("edge_id"), "labels", "other_rows",
    )


def edge_chains(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Source name, labels and target name of every entity edge."""
    return _with_end_names(label_lists(edges, [*ENDS]), shown).select("edge_id", "source_name", "labels", "target_name")


def _with_end_names(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows of edges with the names of both ends.  The smaller end is looked up first: where rows are read by its buckets, only the other
    look-up moves them."""
    names = materialize(shown.select("id", "primary"), "names")
    for end, name in zip(ENDS, ("source_name", "target_name"), strict=True):
        known = names.select(F.col("id").alias(end), F.col("primary").alias(name))
        rows = rows.join(dealt_like(known, end, rows, end), end, "left")
        rows = rows.withColumn(name, F.coalesce(name, F.lit(UNNAMED)))
    return with_edge_id(rows)


def beside(rows: DataFrame, others: DataFrame, column: str) -> DataFrame:
    """Rows with the list of the values that the others have in a column for the same two ends; the list should be short.

    A union and a window instead of a join: Spark moves both sides of a join by two columns though they are dealt by one of them.
    """
    both = rows.withColumn("_own", F.lit(True)).unionByName(others.select(*ENDS, column), allowMissingColumns=True)
    found = both.withColumn(column, F.collect_list(column).over(Window.partitionBy(*ENDS)))
    return found.where("_own").drop("_own")


def first_edges(edges: DataFrame) -> DataFrame:
    """The edge with the smallest id at each end: id, edge_source, edge_target, other.

    Among the edges in which a node is the same end, the id is smallest where the other end with its length is, so nothing longer is moved.
    """
    ways = [F.struct(F.col(near).alias("id"), F.concat(F.char_length(far).cast("string"), F.lit(":"), F.col(far)).alias("far"), F.lit(near == ENDS[0]).alias("is_low"))
            for near, far in (ENDS, ENDS[::-1])]
    each = distinct_ends(edges).select(F.explode(F.array(*ways)).alias("_way")).select("_way.*")
    least = each.groupBy("id").agg(F.min(F.when(F.col("is_low"), F.col("far"))).alias("above"), F.min(F.when(~F.col("is_low"), F.col("far"))).alias("below"))
    above, below = (F.expr(f"substring({c}, instr({c}, ':') + 1)") for c in ("above", "below"))
    ids = edge_id("entity", F.col("id"), above), edge_id("entity", below, F.col("id"))
    is_low = F.coalesce(ids[0] <= ids[1], ids[0].isNotNull())
    return least.select(
        "id", F.when(is_low, F.col("id")).otherwise(below).alias("edge_source"), F.when(is_low, above).otherwise(F.col("id")).alias("edge_target"),
        F.when(is_low, above).otherwise(below).alias("other"),
    )


def node_chains(nodes: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """Each node with the labels and name at the other end of its first edge, or a marker without one."""
    first = first_edges(edges)
    names = materialize(shown.select("id", "primary"), "names")
    others = names.select(F.col("id").alias("other"), F.col("primary").alias("target_name"))
    labelled = beside(dealt_like(first, "edge_source", edges, "edge_source"), label_lists(edges, [*ENDS]), "labels")
    labelled = labelled.select("id", "other", F.explode("labels").alias("labels"))
    joined = nodes.select("id", "display_name").join(names, "id", "left").join(labelled, "id", "left").join(others, "other", "left")
    lone = F.col("other").isNull()
    return joined.select(
        "id",
        F.when(lone, F.col("display_name")).otherwise(F.coalesce("primary", "display_name")).alias("source_name"),
        F.when(lone, F.lit(NO_NEIGHBOUR[1])).otherwise(F.col("labels")).alias("relation"),
        F.when(lone, F.lit(NO_NEIGHBOUR[0])).otherwise(F.coalesce("target_name", F.lit(UNNAMED))).alias("target_name"),
    )


def table_edge_view(shown_tables: DataFrame, support: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """Label, line and direction of the table edges visible at a threshold.

    With resolvable support the visible supporting relations decide; without any, the counts and the
    average confidence of the table edge do.
    """
    resolved = supporting_relations(support, edges).withColumn("is_visible", relation_visible(F.col("strength"), F.col("confidence"), threshold))
    # Few distinct (label, strength, direction) per table edge: count them before gathering.
    kinds = resolved.groupBy("table_edge_id", "is_visible", "display_label", "strength", "direction").agg(F.count(F.lit(1)).alias("n"))
    return table_view_of(shown_tables, kinds, threshold)


def supporting_relations(support: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations behind table edges, by the ends of edges where the support tells them (``graph.support_ends``), else by their ids."""
    key = [*ENDS] if set(ENDS) <= set(support.columns) else ["edge_id"]
    relations = edges.select(*key, "display_label", "strength", "direction", "confidence")
    if key == [*ENDS] and buckets_of(edges, ENDS[0]):
        return beside(relations, support, "table_edge_id").withColumn("table_edge_id", F.explode("table_edge_id"))
    return support.join(dealt(relations, key, edges), key)


def table_view_of(shown_tables: DataFrame, kinds: DataFrame, threshold: float) -> DataFrame:
    """The view from the kinds of supporting relations: table_edge_id, display_label, strength, direction, is_visible."""
    visible = F.col("is_visible")
    summary = kinds.groupBy("table_edge_id").agg(
        F.bool_or("is_visible").alias("any_visible"),
        F.array_join(F.array_sort(F.collect_set(F.when(visible, F.col("display_label")))), LABEL_SEPARATOR).alias("seen_labels"),
        F.coalesce(F.bool_or(F.when(visible, F.col("strength") == "strong")), F.lit(False)).alias("seen_strong"),
        shared_direction(F.collect_set(F.when(visible, F.col("direction")))).alias("seen_direction"),
    )
    joined = shown_tables.join(summary, F.col("id") == F.col("table_edge_id"), "left")
    resolvable = F.col("any_visible").isNotNull()
    by_counts = relation_visible(F.when(F.col("strong_count") > 0, "strong").otherwise("weak"), F.col("average_confidence"), threshold)
    mixed = (F.col("strong_count") > 0) & (F.col("weak_count") > 0)
    type_labels = F.array_join(
        F.array_sort(F.array_distinct(F.transform("relation_types", relation_type_label))), LABEL_SEPARATOR
    )
    return joined.where(F.coalesce("any_visible", by_counts)).select(
        "id",
        F.when(resolvable, F.col("seen_labels")).when(mixed, F.lit(MIXED_LABEL)).otherwise(type_labels).alias("label"),
        F.when(F.coalesce("seen_strong", F.col("strong_count") > 0), F.lit("solid")).otherwise(F.lit("dashed")).alias("line_style"),
        F.when(resolvable, F.col("seen_direction")).otherwise(F.lit("undirected")).alias("direction"),
    )


def drill_down(support: DataFrame, edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The entity edges behind each table edge with names and labels; missing ones are marked."""
    if set(ENDS) <= set(support.columns):
        # Told by the ends of edges (``graph.support_ends``), so an edge's labels are where its support is, and its names are looked up once.
        labelled = beside(support, label_lists(edges, [*ENDS]), "labels").withColumn("labels", F.explode_outer("labels"))
        joined = _with_end_names(labelled, shown)
        for name in ("source_name", "target_name"):
            joined = joined.withColumn(name, F.when(F.col("labels").isNotNull(), F.col(name)))
    else:
        joined = support.join(edge_chains(edges, shown), "edge_id", "left")
    return joined.select(
        "table_edge_id",
        "edge_id",
        "source_name",
        "target_name",
        F.coalesce("labels", F.lit(MISSING_SUPPORT)).alias("labels"),
        F.col("source_name").isNull().alias("is_missing"),
    )


def table_edge_detail(shown_tables: DataFrame) -> DataFrame:
    """Counts and confidence band of each table edge."""
    return shown_tables.select(
        "id", "source_table", "target_table", "strong_count", "weak_count", "entity_edge_count",
        confidence_band(F.col("average_confidence")).alias("confidence_band"),
    )


def graph_overview(tables: DataFrame, nodes: DataFrame, shown_tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes of the four parts of the graph."""
    parts = {
        "table_node_count": tables, "entity_node_count": nodes,
        "table_edge_count": shown_tables, "entity_edge_count": distinct_ends(edges),
    }
    return side_by_side(*[part.agg(F.count(F.lit(1)).alias(name)) for name, part in parts.items()])


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node."""
    members = reachable_among(nodes.select("id"), edges.select(F.col("edge_target").alias("u"), F.col("edge_source").alias("v")))
    return nodes.select("id").join(members, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reachable_among(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``smallest_reachable`` over the pairs with both ends among the ids.  Others have no number at one end and are dropped by the look-up."""
    return _reachable(pairs, _numbered(ids.where("id IS NOT NULL").distinct()))


def smallest_reachable(pairs: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in the pairs (u, v) that has a smaller one: id, component.

    Rounds of contraction until no pair is left: every id hangs on the smallest one around it, the trees are flattened by doubling, and
    pairs are drawn between their roots.  Two rounds at least halve the ids of a component, and most pairs fall inside a tree at once.  Joins have
    one row per key on the other side, so a hub's pairs can be split between tasks.  Rounds are stored and the one before is removed;
    their number grows with the logarithm of the component size.  They move numbers in the order of the ids, not the ids.
    """
    apart = Stored(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    return _reachable(apart.frame, _numbered(apart.frame.select(F.explode(F.array("u", "v")).alias("id")).distinct()))


def _reachable(pairs: DataFrame, numbers: Stored) -> DataFrame:
    """``smallest_reachable`` over the pairs whose ids have a number."""
    names, linked = numbers.frame, pairs.where("u <> v")
    # The smaller end first: edges that are read by its buckets are moved for the other end only.
    for end in ("v", "u"):
        known = names.select(F.col("id").alias(end), F.col("number").alias(f"{end}_number"))
        linked = linked.join(dealt_like(known, end, linked, end), end)
    ordered = linked.select(F.greatest("u_number", "v_number").alias("u"), F.least("u_number", "v_number").alias("v"))
    least = _least_numbers(Stored(ordered, "star"))
    of_id = least.join(names.select(F.col("number").alias("u"), "id"), "u")
    return of_id.join(names.select(F.col("number").alias("v"), F.col("id").alias("component")), "v").select("id", "component")


def _numbered(ids: DataFrame) -> Stored:
    """Distinct ids with numbers that are in the same order: the range of an id and its place there."""
    ranged = ids.repartitionByRange("id").sortWithinPartitions("id")
    return Stored(ranged.select("id", F.monotonically_increasing_id().alias("number")), "numbers")


def _least_numbers(now: Stored) -> DataFrame:
    """Smallest reachable number of every number in the stored pairs (u > v) that has a smaller one: u, v.

    The smallest number of a component is a root in every round, so all others end there.
    """
    least = None
    while True:
        roots = _flat(_hung(now.frame))
        if roots is None:
            return least.frame if least else now.frame
        done = [now]
        now = Stored(_between_roots(now.frame, roots.frame), "star")
        if least is None:
            least = roots
        else:
            done += [least, roots]
            least = Stored(_at_roots(least.frame, roots.frame, "v").unionByName(roots.frame), "least")
        for stored in done:
            stored.remove()


def _hung(pairs: DataFrame) -> Stored:
    """Every number with a smaller one around it, and the smallest of those: u, v.  A smaller one is v of a pair, so no pair is turned."""
    return Stored(pairs.groupBy("u").agg(F.min("v").alias("v")), "tree")


def _flat(tree: Stored) -> Stored | None:
    """The tree with every number on its root, by doubling the steps; none for an empty one."""
    if tree.frame.isEmpty():
        tree.remove()
        return None
    while True:
        above = tree.frame.select(F.col("u").alias("v"), F.col("v").alias("_above"))
        if tree.frame.join(above, "v", "left_semi").isEmpty():
            return tree
        higher, before = Stored(tree.frame.join(above, "v", "left").select("u", F.coalesce("_above", "v").alias("v")), "tree"), tree
        tree = higher
        before.remove()


def _between_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs drawn between the roots of their ends, each once and none inside a tree."""
    for end in ("u", "v"):
        pairs = _at_roots(pairs, roots, end)
    apart = pairs.where("u <> v")
    return apart.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _at_roots(pairs: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    """The pairs with the root of one end in its place; a number without one is a root."""
    known = roots.select(F.col("u").alias(end), F.col("v").alias("_root"))
    return pairs.join(known, end, "left").withColumn(end, F.coalesce("_root", end)).select("u", "v")
