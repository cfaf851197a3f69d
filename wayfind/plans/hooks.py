"""Profile hooks that yield rows, as table functions over tables of questions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.sources.profile import Profile


def pack_files_function(profile: Profile):
    """A table function (pos, path): the files that a profile adds for the tokens of a question."""

    class PackFiles:
        def eval(self, tokens: list[str]) -> Iterator[tuple[int, str]]:
            yield from enumerate(profile.pack_files_for_intents(list(tokens or [])))

    return F.udtf(PackFiles, returnType="pos int, path string")


def injected_files(planned: DataFrame, profile: Profile) -> DataFrame:
    """(question_id, pos, path) for planned questions; a question without such files has no row.

    The function runs beside the rows (a lateral join), so nothing is shuffled.
    """
    function = pack_files_function(profile)
    return planned.select("question_id", "tokens").lateralJoin(function(F.col("tokens").outer())).select("question_id", "pos", "path")
