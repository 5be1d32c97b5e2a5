"""A dialogue on a clock with a policy that answers.

The policy decides after every user piece from what it has heard so far; a reply is queued after the reply before it and
stops when the user speaks again (barge-in). What a general policy does can't be written as a window, so one dialogue is
one group of ``applyInPandas``; for policies that look at the piece alone ``operators.pieces.replies`` is enough.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

Policy = Callable[[list[dict]], tuple[str, int]]


def after_turn(heard: list[dict]) -> tuple[str, int]:
    """Answers when the user's turn ends."""
    return ("speak", 20) if heard[-1]["ends_turn"] else ("wait", 0)


def every_piece(heard: list[dict]) -> tuple[str, int]:
    return "speak", 3


def never(heard: list[dict]) -> tuple[str, int]:
    return "wait", 0


def simulate(pieces: DataFrame, policy: Policy, delay: float = 0.2, rate: float = 3.25, shortest: float = 0.35) -> DataFrame:
    """conv_id, turn (that was answered), start, end, natural_end, stopped of every reply that was heard.

    ``pieces``: conv_id, turn, piece, t_start, t_end, ends_turn, on one clock a dialogue. A reply starts ``delay`` after
    the piece it answers or when the reply before has ended; if the user speaks before it starts, it is dropped; if the
    user speaks while it is heard, it ends there.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["t_start", "turn", "piece"]).to_dict("records")
        heard: list[dict] = []
        replies: list[list] = []
        free = float("-inf")
        for i, piece in enumerate(rows):
            if replies and replies[-1][2] < piece["t_start"] < replies[-1][3]:  # earlier replies have ended where it began
                replies[-1][3], replies[-1][5] = piece["t_start"], True
                free = min(free, piece["t_start"])
            heard.append(piece)
            act, n_words = policy(heard)
            if act != "speak" or not n_words:
                continue
            start = max(piece["t_end"] + delay, free)
            after = rows[i + 1]["t_start"] if i + 1 < len(rows) else float("inf")
            if after <= start:
                continue
            end = start + max(shortest, n_words / rate)
            replies.append([piece["conv_id"], piece["turn"], start, end, end, False])
            free = end
        return pd.DataFrame(replies, columns=["conv_id", "turn", "start", "end", "natural_end", "stopped"])

    schema = "conv_id bigint, turn bigint, start double, end double, natural_end double, stopped boolean"
    return pieces.select("conv_id", "turn", "piece", "t_start", "t_end", "ends_turn").groupBy("conv_id").applyInPandas(run, schema)
