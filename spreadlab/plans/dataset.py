"""A dataset of posts and the tables derived from it, each built once and kept."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from spreadlab.operators import board, cascades, curves, network, standing
from spreadlab.operators.activity import cascade_roots
from spreadlab.session import prepare, settle


class SocialDataset:
    """Posts with companion tables; derived tables are written to the shared folder on first use.

    Tables that are stored already are read where they are. With ``stored`` off the four
    given ones are results of a computation, and written once before they are used.
    """

    def __init__(
        self,
        posts: DataFrame,
        text_scores: DataFrame | None = None,
        profiles: DataFrame | None = None,
        fact_checks: DataFrame | None = None,
        reference_types=network.REFERENCE_TYPES,
        unit: str = "day",
        size: int = 1,
        stored: bool = True,
    ):
        prepare(posts.sparkSession)
        self._posts, self._scores, self._profiles, self._checks = posts, text_scores, profiles, fact_checks
        self.reference_types, self.unit, self.size, self.stored = tuple(reference_types), unit, size, stored

    def _given(self, df: DataFrame, name: str) -> DataFrame:
        return df if self.stored else settle(df, name)

    @cached_property
    def posts(self) -> DataFrame:
        return self._given(self._posts, "posts")

    @cached_property
    def text_scores(self) -> DataFrame:
        return self._given(self._scores, "text_scores")

    @cached_property
    def profiles(self) -> DataFrame:
        return self._given(self._profiles, "profiles")

    @cached_property
    def fact_checks(self) -> DataFrame:
        return self._given(self._checks, "fact_checks")

    @cached_property
    def network(self) -> network.Network:
        vertices, edges = network.network(self.posts, self.reference_types)
        return network.Network(settle(vertices, "vertices"), settle(edges, "edges"))

    @cached_property
    def runs(self) -> standing.Runs:
        return standing.Runs(self.posts, self.unit, self.size)

    @cached_property
    def standing(self) -> DataFrame:
        return settle(standing.add_levels(settle(self.runs.means(), "means")), "standing")

    @cached_property
    def metadata(self) -> DataFrame:
        return settle(standing.actor_metadata(self.posts, self.standing), "metadata")

    @cached_property
    def roots(self) -> DataFrame:
        return settle(cascade_roots(self.posts), "roots")

    @cached_property
    def references(self) -> DataFrame:
        return settle(cascades.cascade_references(self.posts, cascades.members(self.posts)), "references")

    @cached_property
    def nodes(self) -> DataFrame:
        return settle(cascades.cascade_nodes(self.posts, self.references, self.roots), "nodes")

    @cached_property
    def tree(self) -> cascades.Tree:
        edges, tangled = cascades.cascade_tree(self.nodes, self.references, self.network.edges)
        return cascades.Tree(settle(edges, "tree"), tangled)

    @cached_property
    def positions(self) -> DataFrame:
        return settle(cascades.cascade_positions(self.nodes, self.tree), "positions")

    @cached_property
    def curves(self) -> DataFrame:
        return settle(curves.cascade_curves(self.positions, self.tree), "curves")

    @cached_property
    def board(self) -> DataFrame:
        return settle(
            board.board(self.posts, self.fact_checks, self.profiles, self.text_scores, self.standing), "board"
        )
