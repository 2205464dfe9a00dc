"""Best paths through a machine of states for many sequences side by side: a row a state, a column a sequence.

Forward, only the best score of each state is kept. Which state a path came from
is found again on the way back, for the one state that it stands in, so that a
base costs as many numbers as there are edges and not states times the most
edges into one.
"""

from __future__ import annotations

import numpy as np


class Lattice:
    """Edges of all contexts as one list; an edge that a context lacks costs infinitely much there.

    before has, by context and state, the states before it, lowest first; -1
    fills up. changed tells the edges that take the second of two weights. Rows
    are states by falling number of edges, so the k-th edges of all states that
    have so many are one slice.
    """

    def __init__(self, before: np.ndarray, changed: np.ndarray | None = None) -> None:
        self.before, self.changed = before, changed
        states = before.shape[1]
        kind = np.zeros(before.shape, bool) if changed is None else changed
        found: list[dict[tuple[int, bool], list[int]]] = [{} for _ in range(states)]
        for context, state, k in np.argwhere(before >= 0).tolist():
            found[state].setdefault((int(before[context, state, k]), bool(kind[context, state, k])), []).append(context)
        order = sorted(range(states), key=lambda s: -len(found[s]))
        #: The state of each row, and the row of each state.
        self.state = np.array(order)
        self.row = np.argsort(self.state)
        # A state that nothing leads to has an edge that no context has.
        listed = [sorted(found[s].items()) or [((0, False), [])] for s in order]
        rows, costs, self.layers = [], [], []
        for k in range(max(map(len, listed))):
            own = [one[k] for one in listed if len(one) > k]
            self.layers.append((len(rows), len(own)))
            for (a, change), where in own:
                cost = np.full(before.shape[0], -np.inf)
                cost[where] = 0.0
                rows.append(int(self.row[a]) + states * change)
                costs.append(cost)
        self.source, self.cost = np.array(rows), np.array(costs)

    def best(self, scores: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The best of each state's edges. scores are those of the rows and, where edges have two weights, first with the one and then with the other added."""
        value = np.take(scores, self.source, axis=0, mode="clip")
        value += np.take(self.cost, context, axis=1, mode="clip")
        low, n = self.layers[0]
        out = value[low : low + n]
        for low, n in self.layers[1:]:
            np.maximum(out[:n], value[low : low + n], out=out[:n])
        return out

    def came(self, scores: np.ndarray, context: np.ndarray, state: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For a state of each column, the state before it on the best path, -1 where none leads to it, and that edge's score; of equals the lowest.

        weights are the two weights of a step by column.
        """
        before, at = self.before[context, state], np.arange(len(context))[:, None]
        value = scores[self.row[np.maximum(before, 0)], at]
        if weights is not None:
            value = value + weights.T[at, self.changed[context, state].astype(np.int64)]
        value = np.where(before >= 0, value, -np.inf)
        first = value.argmax(1)[:, None]
        return np.take_along_axis(before, first, 1)[:, 0], np.take_along_axis(value, first, 1)[:, 0]
