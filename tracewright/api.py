"""The miner: from a log to an annotated object flow net."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalar import shown_text
from .model import FINAL, INITIAL, INNER, EventLog
from .operators import filters, massbalance, variants, waste
from .operators.components import cut
from .operators.roles import roles
from .plans import net as nets
from .plans.render import dot


@dataclass(frozen=True)
class MinerParameters:
    remove_object_types: list[str] = field(default_factory=list)
    hint_initial_input: list[str] = field(default_factory=list)
    hint_final_output: list[str] = field(default_factory=list)
    hint_inner: list[str] = field(default_factory=list)
    calculate_masses: bool = False
    filter_configurations: float = 0.0  # alpha
    filter_arcs: float = 0.0  # beta
    keep_general: bool = False
    show_helper_text: bool = False
    annotate_objects_count: list[str] = field(default_factory=list)
    annotate_objects_mass: list[str] = field(default_factory=list)
    annotate_explicit: list[str] = field(default_factory=list)
    annotate_implicit_count: list[str] = field(default_factory=list)
    annotate_implicit_mass: list[str] = field(default_factory=list)
    direction: str = "LR"

    def hints(self) -> dict[str, str]:
        """Role by type; a type in several lists is a final output before an initial input before an inner one."""
        return dict.fromkeys(self.hint_inner, INNER) | dict.fromkeys(self.hint_initial_input, INITIAL) | dict.fromkeys(self.hint_final_output, FINAL)


@dataclass(frozen=True)
class Discovery:
    roles: DataFrame
    events: DataFrame
    variants: DataFrame
    associations: DataFrame
    net: nets.FlowNet
    balance: massbalance.Balance | None


@dataclass(frozen=True)
class ObjectFlowNet:
    dot_str: str


def discover(log: EventLog, parameters: MinerParameters = MinerParameters(), weighted: bool = False) -> Discovery:
    """Filter types, infer roles, balance masses, aggregate, filter variants and neighbours, build and check the net."""
    p = parameters
    log = filters.drop_object_types(log, p.remove_object_types)
    found, balance = cut(roles(log.relations, p.hints()), "roles"), None
    if p.calculate_masses:
        balance = massbalance.resolve(found, log.masses())
        found = balance.roles
    events = cut(variants.variant_events(found, weighted), "variant-events")
    kinds = filters.filter_variants(variants.variants(events), filters.above(p.filter_configurations))
    if p.keep_general:
        kinds = filters.keep_general(kinds)
    kinds = cut(kinds, "variants")
    near = variants.associations(found, events).join(kinds.select("variant_id"), "variant_id", "left_semi")
    near = cut(filters.filter_associations(near, filters.above(p.filter_arcs)), "associations")
    net = nets.build(kinds, near)
    nets.check(net)
    return Discovery(found, events, kinds, near, net, balance)


def _at_places(net: nets.FlowNet, otype: str, measure: DataFrame) -> DataFrame:
    """Each variant's measure with the place of the type's initial inputs or final outputs there."""
    ends = net.places.where(F.col("otype") == otype).select("place", F.when(F.col("is_initial"), INITIAL).when(F.col("is_final"), FINAL).alias("role"))
    at = net.arcs.join(ends, "place").select(F.col("transition").alias("variant_id"), "role", "place")
    return measure.join(at, ["variant_id", "role"])


def annotations(log: EventLog, found: Discovery, parameters: MinerParameters, check: bool = True) -> DataFrame:
    """(place, transition, variant_id, rank, line): what is printed at places and transitions, in order of ``rank``.

    A line belongs to a place or a transition. A later measure of a kind replaces an earlier
    one of the same variant: counts, masses, explicit or implicit waste. A variant whose
    objects of a type are initial and final is an error, unless ``check`` is off.
    """
    p, masses, parts = parameters, log.masses(), []
    live = found.events.join(found.variants.select("variant_id"), "variant_id", "left_semi")
    number = shown_text

    def add(measure: DataFrame, kind: str, line: Column, at_place: bool) -> None:
        place = F.col("place") if at_place else F.lit(None).cast("int")
        transition = F.lit(None).cast("string") if at_place else F.col("variant_id")
        parts.append(measure.select(place.alias("place"), transition.alias("transition"), "variant_id", F.lit(kind).alias("kind"), F.lit(len(parts)).alias("rank"), line.alias("line")))

    pair = lambda what, average: F.concat(F.lit(f"{what}: avg "), number(F.col(average)), F.lit(" / total "), number(F.col("total")))
    for otype in p.annotate_objects_count:
        add(_at_places(found.net, otype, waste.type_count(found.roles, live, otype, check)), "count", F.concat(F.lit(f"{otype}: "), F.col("total").cast("string")), True)
    for otype in p.annotate_objects_mass:
        add(_at_places(found.net, otype, waste.type_mass(found.roles, masses, live, otype, check)), "mass", pair(f"{otype} mass", "rounded"), True)
    for activity in p.annotate_explicit:
        add(waste.explicit_waste(live, log.events, activity, "mass"), "explicit", pair("Explicit mass", "average"), False)
    for activity in p.annotate_implicit_count:
        add(waste.implicit_count(found.roles, live, activity), "implicit", F.concat(F.lit("Implicit count: "), F.col("total").cast("string")), False)
    for activity in p.annotate_implicit_mass:
        add(waste.implicit_mass(found.roles, masses, live, activity), "implicit", pair("Implicit mass", "average"), False)
    if not parts:
        return log.events.sparkSession.createDataFrame([], "place int, transition string, variant_id string, rank int, line string")
    last = F.max(F.struct("rank", "line")).alias("_last")
    return reduce(DataFrame.unionAll, parts).groupBy("place", "transition", "variant_id", "kind").agg(last).select("place", "transition", "variant_id", "_last.rank", "_last.line")


class ObjectFlowMiner:
    """Nets with weighted or variable arcs, plain or annotated."""

    def weighted_arcs(self, log: EventLog, parameters: MinerParameters = MinerParameters()) -> ObjectFlowNet:
        return self._plain(log, parameters, True)

    def variable_arcs(self, log: EventLog, parameters: MinerParameters = MinerParameters()) -> ObjectFlowNet:
        return self._plain(log, parameters, False)

    def annotated_weighted_arcs(self, log: EventLog, parameters: MinerParameters = MinerParameters()) -> ObjectFlowNet:
        return self._annotated(log, parameters, True)

    def annotated_variable_arcs(self, log: EventLog, parameters: MinerParameters = MinerParameters()) -> ObjectFlowNet:
        return self._annotated(log, parameters, False)

    def _plain(self, log: EventLog, p: MinerParameters, weighted: bool) -> ObjectFlowNet:
        found = discover(log, p, weighted)
        return ObjectFlowNet(dot(found.net, weighted, p.direction, help_text=p.show_helper_text))

    def _annotated(self, log: EventLog, p: MinerParameters, weighted: bool) -> ObjectFlowNet:
        found = discover(log, p, weighted)
        lines = defaultdict(list)
        for r in annotations(log, found, p).orderBy("rank", "place", "variant_id").collect():  # as many as the model has arcs, for each measure
            lines[r["place"] if r["transition"] is None else r["transition"]].append(r["line"])
        return ObjectFlowNet(dot(found.net, weighted, p.direction, lines, p.show_helper_text))
