"""One-to-one matching of numbers under a tolerance."""

from __future__ import annotations

from docfacts.functions.sql import fresh, let, only

_QUEUE = "array<struct<v:double,n:bigint>>"


def _without_first(queue: str, count: str) -> str:
    """A queue of ``v, n`` entries after ``count`` items have been taken from its front."""
    a, e, r = fresh(), fresh(), fresh()
    rest = f"array_append({a}.out, named_struct('v', {e}.v, 'n', {e}.n - {a}.owed))"
    return (
        f"aggregate({queue}, named_struct('owed', {count}, 'out', cast(array() as {_QUEUE})),"
        f" ({a}, {e}) -> named_struct('owed', greatest(0L, {a}.owed - {e}.n), 'out', if({e}.n > {a}.owed, {rest}, {a}.out)), {r} -> {r}.out)"
    )


def matches_within(entries: str, tolerance: float) -> str:
    """The largest number of pairs of a left and a right number that differ by ``tolerance`` at most, each number used once.

    ``entries`` is an array of ``struct<v: double, p: bigint, l: bigint>`` ascending in ``v``, all different: ``p`` numbers on the left and ``l`` on the
    right have this value. One sweep with a queue of the unmatched numbers of one side: the next number of the other side takes the
    oldest that is still near enough. (Both sides never wait at once, and the oldest has the fewest chances left, so no other choice gives more pairs.)
    """
    a, x, r = fresh(), fresh(), fresh()
    near = only(f"{a}.queue", lambda e: f"{x}.v - {e}.v <= {tolerance!r}D")
    t, e = fresh(), fresh()

    def step(s: str) -> str:
        def settle(m: str) -> str:
            # m: pairs with the queue; then pairs among the numbers of this value; what is left of either side waits.
            inner = f"least({s}.own, {s}.other - {m}.met)"
            over = f"({s}.other - {m}.met - {inner})"
            waiting = f"array(named_struct('v', {x}.v, 'n', {{0}}))"
            own = f"({s}.own - {inner})"
            queue = (
                f"if({over} > 0, {waiting.format(over)},"
                f" concat({_without_first(f'{s}.queue', f'{m}.met')}, if({own} > 0, {waiting.format(own)}, cast(array() as {_QUEUE}))))"
            )
            return f"named_struct('left', if({over} > 0, not {a}.left, {a}.left), 'queue', {queue}, 'pairs', {a}.pairs + {m}.met + {inner})"

        total = f"aggregate({s}.queue, 0L, ({t}, {e}) -> {t} + {e}.n)"
        return let(f"named_struct('met', least({s}.other, {total}))", settle)

    state = f"named_struct('queue', {near}, 'own', if({a}.left, {x}.p, {x}.l), 'other', if({a}.left, {x}.l, {x}.p))"
    start = f"named_struct('left', true, 'queue', cast(array() as {_QUEUE}), 'pairs', 0L)"
    return f"aggregate({entries}, {start}, ({a}, {x}) -> {let(state, step)}, {r} -> {r}.pairs)"
