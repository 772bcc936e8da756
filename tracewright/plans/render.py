"""A net as it is drawn: nodes and arcs with their looks as a DataFrame, and DOT text of it.

The text is made of collected rows: a net's size is that of the model.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contrast
from .net import IN, FlowNet

# Colours of object types, dealt in order of first appearance.
PALETTE = ("#ffa500", "#7b68ee", "#eec900", "#00bfff", "#32cd32", "#ff0000", "#ff1493", "#605D6E", "#132845", "#9ED020")


# Colours of some types, by name.
NAMED = {
    "Container": "#00bfff",
    "Handling Unit": "#32cd32",
    "Transport Document": "#7b68ee",
    "Customer Order": "#ffa500",
    "Truck": "#ff0000",
    "Forklift": "#ff1493",
    "Workstation": "#e18ceb",
    "Worker": "#1f3721",
    "Machine": "#3B3B3B",
}


def colours(types: list[str]) -> dict[str, str]:
    """A colour for each type, given by first appearance: its own, or the next of the palette; beyond that, one made from its name."""
    out = {name: NAMED[name] for name in types if name in NAMED}
    for k, name in enumerate(t for t in dict.fromkeys(types) if t not in NAMED):
        made = sum((i + 1) * ord(c) * 2654435761 for i, c in enumerate(name)) & 0xFFFFFF
        out[name] = PALETTE[k] if k < len(PALETTE) else f"#{made:06x}"
    return out


def ink(colour: str) -> str:
    return contrast(*(int(colour[i : i + 2], 16) for i in (1, 3, 5)))


def drawing(net: FlowNet, weighted: bool = False) -> DataFrame:
    """(kind, place, transition, direction, label, shape, colour, ink, style, width, help), one row a place, transition or arc.

    Initial and final places have shapes of their own, silent transitions are black; arcs
    have their places' colours, dashed for unknown roles; arcs of several tokens have a
    label if ``weighted``, else a wide line.
    """
    order = net.types if net.types is not None else net.places.groupBy("otype").agg(F.min("place").alias("first"))
    dealt = colours([r["otype"] for r in order.orderBy("first", "otype").collect()])  # one row a type
    looks = F.create_map(*(F.lit(x) for t, c in dealt.items() for x in (t, c))) if dealt else F.create_map().cast("map<string,string>")
    inks = F.create_map(*(F.lit(x) for t, c in dealt.items() for x in (t, ink(c)))) if dealt else looks
    none = F.lit(None).cast("string")

    def row(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        names = ("transition", "direction", "label", "shape", "colour", "ink", "style")
        place = columns.get("place", F.lit(None)).cast("int").alias("place")
        return df.select(F.lit(kind).alias("kind"), place, *(columns.get(n, none).alias(n) for n in names), columns.get("width", F.lit(None)).cast("double").alias("width"), columns.get("help", none).alias("help"))

    shape = F.when(F.col("is_final"), "doubleoctagon").when(F.col("is_initial"), "octagon").otherwise("circle")
    help_text = F.concat(F.array_join("ins", ", "), F.lit(" → "), F.array_join("outs", ", "))
    parts = row(net.places, "place", place=F.col("place"), label=F.col("otype"), shape=shape, colour=looks[F.col("otype")], ink=inks[F.col("otype")], help=help_text)
    silent = F.col("activity").isNull()
    black, white = F.when(silent, "#000000"), F.when(silent, "#ffffff")
    parts = parts.unionAll(row(net.transitions, "transition", transition=F.col("transition"), label=F.coalesce("activity", F.lit("τ")), shape=F.lit("box"), colour=black, ink=white, help=F.when(~silent, F.concat(F.col("n").cast("string"), F.lit(" events")))))
    several = F.col("multiplicity") > 1
    arcs = net.arcs.join(net.places.select("place", "otype", "is_unknown"), "place")
    label = F.when(several, F.col("multiplicity").cast("string")) if weighted else none
    width = F.lit(None) if weighted else F.when(several, 4.0)
    return parts.unionAll(row(arcs, "arc", place=F.col("place"), transition=F.col("transition"), direction=F.col("direction"), label=label, colour=looks[F.col("otype")], style=F.when(F.col("is_unknown"), "dashed"), width=width))


def dot(net: FlowNet, weighted: bool = False, direction: str = "LR", notes: dict[str, list[str]] | None = None, help_text: bool = False) -> str:
    """``notes``: lines to print in a transition's or place's box, by transition id or place number."""
    notes = notes or {}
    rows = [r.asDict() for r in drawing(net, weighted).collect()]
    places = sorted((r for r in rows if r["kind"] == "place"), key=lambda r: r["place"])
    transitions = sorted((r for r in rows if r["kind"] == "transition"), key=lambda r: (r["colour"] is not None, r["transition"]))
    arcs = sorted((r for r in rows if r["kind"] == "arc"), key=lambda r: (r["transition"], r["place"], r["direction"]))
    number = {t["transition"]: k for k, t in enumerate(transitions)}
    lines = ["digraph net {", f'  rankdir="{direction}";', "  node [fontname=Helvetica];"]

    def label(r: dict, key) -> str:
        text = [r["label"], *([r["help"]] if help_text and r["help"] else []), *map(str, notes.get(key, []))]
        return "<BR/>".join(escape(x) for x in text)

    for p in places:
        shape = "ellipse" if p["shape"] == "circle" and (notes.get(p["place"]) or help_text) else p["shape"]
        lines.append(f'  p{p["place"]} [label=<{label(p, p["place"])}>, shape={shape}, style=filled, fillcolor="{p["colour"]}", fontcolor="{p["ink"]}"];')
    for t in transitions:
        if t["colour"]:
            lines.append(f'  t{number[t["transition"]]} [label="{t["label"]}", shape=box, style=filled, fillcolor="{t["colour"]}", fontcolor="{t["ink"]}"];')
        else:
            lines.append(f"  t{number[t['transition']]} [label=<{label(t, t['transition'])}>, shape=box];")
    for a in arcs:
        place, transition = f"p{a['place']}", f"t{number[a['transition']]}"
        ends = f"{place} -> {transition}" if a["direction"] == IN else f"{transition} -> {place}"
        style = [f'color="{a["colour"]}"']
        if a["style"]:
            style += [f"style={a['style']}", "dir=both"]
        if a["label"]:
            style.append(f'label="{a["label"]}"')
        if a["width"]:
            style.append(f"penwidth={a['width']}")
        lines.append(f"  {ends} [{', '.join(style)}];")
    return "\n".join([*lines, "}", ""])
