"""SuperMinHash signatures of sets of 64-bit elements.

Each element walks through a random permutation of the slots, one slot a round, and offers the
slot the value ``round + uniform``. A slot keeps the least offer. As the offers of one element are
spread over all slots and no slot gets two of the same round, the estimate varies less than with
independent minima; and as offers of later rounds are larger, the walk of a set ends once every
slot holds an offer of a round already played. Many sets walk together, to keep numpy busy.
"""

from __future__ import annotations

import numpy as np

from rankwright.llm.words import mix

#: Rounds in which swaps are traced back; sets that walk on get a table of their permutations.
TRACED_ROUNDS = 5

_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(elements: np.ndarray, first: np.ndarray, slots: int, seed: int = 1) -> np.ndarray:
    """A row of ``slots`` doubles for each set ``elements[first[i]:first[i + 1]]``.

    Two sets agree in a slot with the probability of their Jaccard similarity. The elements of a
    set must be distinct; a row of an empty set is infinite.
    """
    kind = np.uint8 if slots <= 256 else np.int32
    sets = len(first) - 1
    least = np.full((sets, slots), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(first))
    state = mix(elements ^ np.uint64(seed))
    swaps: list[np.ndarray] = []
    table = None
    for turn in range(slots):
        state = state + _STEP
        draw = mix(state)
        offer = turn + (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = mix(draw ^ _STEP) >> np.uint64(33)
        pick = turn + ((pick * np.uint64(slots - turn)) >> np.uint64(31)).astype(np.int64)
        if turn == TRACED_ROUNDS:
            rows = np.arange(len(state))
            table = np.tile(np.arange(slots, dtype=kind), (len(state), 1))
            for before, swap in enumerate(swaps):
                held = table[rows, swap]
                table[rows, swap] = table[rows, before]
                table[rows, before] = held
        if table is None:
            place = pick.copy()
            for before in range(turn - 1, -1, -1):
                place[place == swaps[before]] = before
            swaps.append(pick)
        else:
            place = table[rows, pick].astype(np.int64)
            table[rows, pick] = table[rows, turn]
        np.minimum.at(flat, owner * slots + place, offer)
        walks_on = least.max(axis=1) >= turn + 1
        stays = walks_on[owner]
        if not stays.any():
            break
        if not stays.all():
            state, owner = state[stays], owner[stays]
            swaps = [swap[stays] for swap in swaps]
            if table is not None:
                table = table[stays]
                rows = np.arange(len(state))
    return least


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    """For each signature one 64-bit key per band of slots; bands never share keys by design."""
    codes = mix(least.view(np.uint64)).reshape(len(least), bands, -1)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(least), 1))
    for part in range(codes.shape[2]):
        keys = mix(keys ^ codes[:, :, part]) + codes[:, :, part]
    return mix(keys)
