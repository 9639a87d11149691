"""Block summaries of the replays: what a block of rows makes of any state that it may start from.

A summary is a transition function: a few start cases, each with the state it ends in. Control values are tried out, for
all of them at once; registers (a frame, a range) are kept or set; the counter of a state (its generation, run, revision
or submissions) is an offset to the one it starts with. Cases whose states have met go on as one, so a row costs a step for
each distinct state, which soon are few.

``result()`` is plain data and goes through JSON. ``follow(result, state)`` gives the block's end for a real start and says
whether it is sure; it is not where a start lies outside what the summary has followed. The fold then runs such a block
from that start and uses what it finds, so replays are exact in any case and summaries only save rounds.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush

# Stands for an unknown frame: so far below every real one that a block can add to it without meeting a range.
_FAR = -(10**12)


class Meeting:
    """Cases that are stepped together: equal states become one node, and a node knows how far its counter has come.

    A case that has met another is linked to it with the difference of their counters, as in a union of sets.
    """

    def __init__(self, step, counter: int):
        self.step_row, self.counter = step, counter
        self.live: dict[tuple, int] = {}
        self.up: list[int] = []
        self.apart: list[int] = []
        self.gain: list[int] = []
        self.cache: dict[tuple, tuple] = {}
        self.calls = 0

    def add(self, state: tuple) -> int:
        """A node for a state whose counter is 0: the one that is in it, if there is one."""
        if state in self.live:
            return self.live[state]
        self.up.append(len(self.up))
        self.apart.append(0)
        self.gain.append(0)
        self.live[state] = self.up[-1]
        return self.up[-1]

    def case(self, state: tuple) -> tuple[int, int]:
        """A handle for a case that is in this state now: its node and its counter less the node's."""
        node = self.add(state)
        return node, -self.gain[node]

    def total(self, handle: tuple[int, int]) -> tuple[int, int]:
        """Node in which a case now is, and its counter."""
        node, off = handle
        while self.up[node] != node:
            off, node = off + self.apart[node], self.up[node]
        return node, off + self.gain[node]

    def after(self, state: tuple, row: tuple) -> tuple:
        key = (state, row)
        if key not in self.cache:
            if len(self.cache) > 4096:
                self.cache.clear()
            self.calls += 1
            self.cache[key] = self.step_row(state, (0, *row))[0]
        return self.cache[key]

    def advance(self, row: tuple) -> None:
        """One row, without its number, for every distinct state."""
        at, moved = self.counter, {}
        for state, node in self.live.items():
            new = self.after(state, row)
            if new[at]:
                self.gain[node] += new[at]
                new = (*new[:at], 0, *new[at + 1 :])
            other = moved.setdefault(new, node)
            if other != node:
                self.up[node], self.apart[node] = other, self.gain[node] - self.gain[other]
        self.live = moved

    def states(self) -> dict[int, tuple]:
        return {node: state for state, node in self.live.items()}


class ControlProbe:
    """For machines of a few control values with registers that no rule looks into, and a counter.

    ``control(state)`` names a start case. Registers of a start case hold ``kept``; where an end still holds it, the real
    start's value goes on. ``assumed`` are registers that rules do look into: a block takes them from its first row, and
    a start that holds others there is not sure.
    """

    def __init__(self, step, counter, starts, registers=(), assumed=None):
        self.meeting, self.starts, self.registers, self.assumed = Meeting(step, counter), starts, registers, assumed
        self.counter, self.cases = counter, None

    def step(self, row) -> None:
        if self.cases is None:
            self.cases = []
            for s in self.starts:
                if self.assumed:
                    flag, places, given = self.assumed
                    s = tuple(row[given[places.index(i)]] if i in places and s[flag] else v for i, v in enumerate(s))
                self.cases.append((s, self.meeting.case(s)))
        self.meeting.advance(tuple(row[1:]))

    @property
    def calls(self) -> int:
        return self.meeting.calls

    def result(self):
        ends, told = self.meeting.states(), []
        for start, handle in self.cases or ():
            node, gain = self.meeting.total(handle)
            told.append([start, ends[node], gain])
        return {"counter": self.counter, "registers": list(self.registers), "assumed": self.assumed and [self.assumed[0], list(self.assumed[1])], "cases": told}

    @staticmethod
    def follow(result, state):
        counter, registers, assumed = result["counter"], result["registers"], result["assumed"]
        flag, places = assumed or (None, [])
        free = {counter, *registers, *places}
        shape = lambda s: [(v is not None) if i in registers else None if i in free else v for i, v in enumerate(s)]
        for start, end, gain in result["cases"]:
            if shape(start) == shape(state):
                held = all(start[i] == state[i] for i in places) if assumed and start[flag] else True
                out = [state[i] if i in (*registers, *places) and v == _FAR else v for i, v in enumerate(end)]
                out[counter] = state[counter] + gain
                return tuple(out), held
        return tuple(state), False


class PlayerProbe:
    """For the player: its control values, an unknown frame, and an unknown generation.

    Frame: Play adds to it and Cue and Seek replace it. Each Play that adds more than any before it may meet the range's
    end; for the frames that do, the player is then completed on the last frame, which is one state for all of them.

    Generation: where no command names the right one, all that name one are refused, whatever it is. A command that names
    one is right for one generation only; if it then changes the state, a world of known numbers goes on from there. A
    world is touched by commands without a generation and by those that name its own. ``MOST`` worlds are followed,
    those that most commands have confirmed; what another one, or a frame that has met the end, makes of a right generation
    is not sure.
    """

    MOST, NOTES, COUNTER = 24, 4096, 5

    # Status, has_range, has a frame, armed: only a range gives a frame, and only a frame arms.
    CONTROLS = (
        ("Empty", False, False, False),
        *((status, True, True, armed) for status in ("Loaded", "Ready", "Playing", "Paused", "Stopped", "Completed") for armed in (False, True)),
        *((status, ranged, False, False) for status in ("Loaded", "Stopped") for ranged in (False, True)),
    )

    def __init__(self, step):
        self.blind, self.given = Meeting(step, self.COUNTER), None
        self.cases: list[tuple[int, int]] = []
        # For each node the frames that met the end in it: what had been added to them, their node and counter from then on.
        self.ended: dict[int, list[tuple[int, int, int]]] = {}
        # For nodes that such frames are in: generations, less the counter, that a command named and would have been right.
        self.named: dict[int, list[int]] = {}
        self.tails: set[int] = set()
        self.noted, self.vague = 0, False
        # (generation at the start, least and greatest start frame less the end, state) -> start cases, commands found right.
        self.worlds: dict[tuple, tuple[set[int], int]] = {}
        self.lost: set[tuple[int, int]] = set()

    @property
    def calls(self) -> int:
        return self.blind.calls

    @staticmethod
    def _kept(state) -> bool:
        return state[3] is not None and state[3] < _FAR // 2

    def _met_end(self, state, new) -> bool:
        return self._kept(state) and self._kept(new) and new[3] > state[3]

    @staticmethod
    def _completed(state):
        return ("Completed", *state[1:3], state[7] - 1, False, *state[5:])

    def step(self, row) -> None:
        row = tuple(row[1:])
        if self.given is None:
            self.given = row[4:6]
            for status, ranged, frame, armed in self.CONTROLS:
                self.cases.append(self.blind.case((status, status != "Empty", ranged, _FAR if frame else None, armed, 0, *(self.given if ranged else (None, None)))))
        expected = row[3] if row[0] != "Snapshot" else None
        free = (*row[:3], None, *row[4:])
        born = self._new_worlds(free, expected) if expected is not None else []
        self._step_worlds(free, expected)
        for world, case in born:
            self.worlds.setdefault(world, (set(), 1))[0].add(case)
        while len(self.worlds) > self.MOST:
            # The real one is confirmed again and again; of others the oldest goes.
            least = min(self.worlds, key=lambda w: self.worlds[w][1])
            self.lost |= {(case, least[0]) for case in self.worlds.pop(least)[0]}
        if expected is None:
            self._step_blind(free)

    def _step_blind(self, row) -> None:
        meeting = self.blind
        playing = [(s, n, meeting.gain[n]) for s, n in meeting.live.items() if row[0] == "Play" and self._kept(s)]
        meeting.advance(row)
        for state, node, gain in playing:
            new = meeting.after(state, row)
            if self._met_end(state, new):
                over, apart = meeting.case((*self._completed(new)[:5], 0, *new[6:]))
                self.ended.setdefault(node, []).append((new[3] - _FAR, over, gain + new[5] + apart))
                self.tails.add(over)

    def _chain(self, handle):
        """The nodes that a case has been in, each with its counter less the node's."""
        node, off = handle
        while True:
            yield node, off
            if self.blind.up[node] == node:
                return
            off, node = off + self.blind.apart[node], self.blind.up[node]

    def _moved(self, world, new) -> list[tuple]:
        first, low, high, state = world
        if not self._met_end(state, new):
            return [(first, low, high, new)]
        added = new[3] - _FAR
        return [(first, -added, high, self._completed(new)), (first, low, -added, new)]

    def _known(self, state, row):
        """State after a row that names no generation, for a state whose generation is a real one."""
        new = self.blind.after((*state[:5], 0, *state[6:]), row)
        return (*new[:5], state[5] + new[5], *new[6:])

    def _branches(self, handle):
        """(handle, least and greatest start frame less the end) of a case's frames that have met the end, and of those
        that have not."""
        high = None
        for node, off in self._chain(handle):
            for added, over, apart in self.ended.get(node, ()):
                # What a node met before the case came to it is no more than the case had met by then.
                if high is None or added > -high:
                    yield (over, off + apart), -added, high
                    high = -added
        yield handle, None, high

    def _new_worlds(self, row, expected) -> list[tuple]:
        """Worlds in which this is the first command that is right, for every case that it changes."""
        meeting, born = self.blind, []
        after = {node: (state, meeting.after(state, row)) for state, node in meeting.live.items()}
        if sum(map(len, self.ended.values())) > self.MOST:
            # Too many to follow: what a right generation would do to a frame that has met the end is noted as not sure.
            self.tails = {meeting.total((node, 0))[0] for node in self.tails}
            for node in self.tails:
                if after[node][0] != after[node][1]:
                    self.named.setdefault(node, []).append(expected - meeting.gain[node])
                    self.noted += 1
                    self.vague |= self.noted > self.NOTES
            branches = [(k, handle, None, high) for k, handle in enumerate(self.cases) for _, low, high in self._branches(handle) if low is None]
        else:
            branches = [(k, *b) for k, handle in enumerate(self.cases) for b in self._branches(handle)]
        for k, handle, low, high in branches:
            node, gain = meeting.total(handle)
            (state, new), first = after[node], expected - gain
            apart = lambda w: (w[1] is not None and high is not None and w[1] >= high) or (low is not None and w[2] is not None and low >= w[2])
            if new == state or (k, first) in self.lost or any(w[0] == first and k in c and not apart(w) for w, (c, _) in self.worlds.items()):
                continue
            world = (first, low, high, (*state[:5], expected, *state[6:]))
            born += [(w, k) for w in self._moved(world, (*new[:5], expected + new[5], *new[6:]))]
        return born

    def _step_worlds(self, row, expected) -> None:
        moved: dict[tuple, tuple[set[int], int]] = {}
        for world, (cases, right) in self.worlds.items():
            named = expected == world[3][5]
            for w in self._moved(world, self._known(world[3], row)) if expected is None or named else [world]:
                met, most = moved.get(w, (set(), 0))
                moved[w] = (met | cases, max(most, right + named))
        self.worlds = moved

    def result(self):
        meeting, told = self.blind, []
        for handle in self.cases:
            ended = [[-low, *meeting.total(over), list(self._chain(over))] for over, low, _ in self._branches(handle) if low is not None]
            told.append([*meeting.total(handle), ended])
        return {
            "given": self.given, "states": list(meeting.states().items()), "cases": told, "lost": sorted(self.lost), "vague": self.vague,
            "worlds": [[*w, sorted(c)] for w, (c, _) in self.worlds.items()], "named": [] if self.vague else list(self.named.items()),
        }

    @classmethod
    def follow(cls, result, state):
        status, loaded, has_range, frame, armed, generation, start, end = state
        control = (status, has_range, frame is not None, armed)
        if control not in cls.CONTROLS or not result["cases"]:
            return tuple(state), not result["cases"]
        case = cls.CONTROLS.index(control)
        sure = not has_range or (start, end) == tuple(result["given"])
        here = None if frame is None or end is None else frame - end
        for first, low, high, after, cases in result["worlds"]:
            # Start frames of this world meet the end by high and not before low.
            if first == generation and case in cases and (here is None or ((low is None or here >= low) and (high is None or here < high))):
                return cls._real(after, frame), sure
        at, gain, ended = result["cases"][case]
        sure = sure and [case, generation] not in [list(x) for x in result["lost"]]
        if here is not None:
            place = bisect_left([e[0] for e in ended], -here)
            if place < len(ended):
                _, at, gain, chain = ended[place]
                named = dict((n, v) for n, v in result["named"])
                sure = sure and not result["vague"] and not any(generation + off in named.get(n, ()) for n, off in chain)
        s, l, h, f, a, _, ra, rb = next(s for n, s in result["states"] if n == at)
        return cls._real((s, l, h, f, a, generation + gain, ra, rb), frame), sure

    @staticmethod
    def _real(after, frame):
        s, l, h, f, a, g, ra, rb = after
        return s, l, h, frame + f - _FAR if f is not None and f < _FAR // 2 else f, a, g, ra, rb


class CoverageProbe:
    """For the coverage cursor: the first tick at or past the incoming cursor decides all that follows.

    Each new greatest tick is a case of its own: the cursors up to it that no tick before has met. A tick moves all cursors
    at or before it to one place, where they go on as one, so it costs one step. Of ``MOST`` cases the later are not told
    apart, and cursors beyond them are not sure.
    """

    MOST = 4096

    def __init__(self, step, samples_per_frame):
        self.step_row, self.scale, self.calls = step, samples_per_frame, 0
        self.upto: list[int] = []
        self.cases: list[int] = []
        self.heap: list[tuple[int, int]] = []
        self.up: list[int] = []
        self.apart: list[int] = []
        self.gain: list[int] = []
        self.kept, self.cut = None, False  # node of a cursor past every tick, once there was a reset

    def _node(self) -> int:
        self.up.append(len(self.up))
        self.apart.append(0)
        self.gain.append(0)
        return self.up[-1]

    def _gather(self, limit, state, gained: int) -> None:
        """Cursors up to ``limit`` (None: all) become one, in ``state``."""
        one = None
        while self.heap and (limit is None or self.heap[0][0] <= limit):
            _, node = heappop(self.heap)
            self.gain[node] += gained
            if one is None:
                one = node
            else:
                self.up[node], self.apart[node] = one, self.gain[node] - self.gain[one]
        if one is not None:
            heappush(self.heap, (state[0], one))

    def step(self, row) -> None:
        _, op, frame = row
        if op == "reset":
            self.calls += 1
            if self.kept is None:
                self.kept = self._node()
                heappush(self.heap, (0, self.kept))
            self._gather(None, self.step_row((0, True, 0), row)[0], 0)
            return
        begin = frame * self.scale
        if self.kept is None and (not self.upto or begin > self.upto[-1]):
            if len(self.upto) < self.MOST:
                self.upto.append(begin)
                self.cases.append(self._node())
                heappush(self.heap, (begin, self.cases[-1]))
            else:
                self.cut = True
        if self.heap and self.heap[0][0] <= begin:
            self.calls += 1
            self._gather(begin, self.step_row((begin, True, 0), row)[0], 1)

    def result(self):
        cursors = {node: cursor for cursor, node in self.heap}

        def end(node):
            off = 0
            while self.up[node] != node:
                off, node = off + self.apart[node], self.up[node]
            return [cursors[node], off + self.gain[node]]

        return {"upto": self.upto, "ends": [end(n) for n in self.cases], "kept": None if self.kept is None else end(self.kept), "cut": self.cut}

    @staticmethod
    def follow(result, state):
        covered, submitted, submissions = state
        place = bisect_left(result["upto"], covered)
        sure = place < len(result["upto"]) or not result["cut"]
        end = result["ends"][place] if place < len(result["upto"]) else result["kept"]
        if end is None:
            return tuple(state), sure
        return (end[0], submitted or end[1] > 0, submissions + end[1]), sure


class NoProbe:
    """For machines without a summary: every block is run from its start."""

    calls = 0

    def step(self, row) -> None:
        pass

    def result(self):
        return None

    @staticmethod
    def follow(result, state):
        return tuple(state), False
