"""Rules of the replays: player commands, lifecycle, source lifecycle, coverage cursor.

Each is a small step function on tuples, shared by the batch fold and the streaming processors.
"""

from __future__ import annotations

from .fold import Machine
from .probes import _FAR, ControlProbe, CoverageProbe, PlayerProbe

# ---- player commands ----------------------------------------------------------------------------

# The range is the active one: the input's range from Prepare on, null before that.
PLAYER_STATE = (
    "status string, loaded boolean, has_range boolean, frame bigint, armed boolean, generation bigint, range_start bigint, "
    "range_end bigint"
)
PLAYER_START = ("Empty", False, False, None, False, 0, None, None)
PLAYER_INPUTS = ("seq", "command", "frame", "frame_count", "expected_generation", "range_start", "range_end")
PLAYER_OUT = (
    "seq bigint, command string, accepted boolean, reason string, status string, loaded boolean, has_range boolean, "
    "frame bigint, armed boolean, generation bigint, range_start bigint, range_end bigint"
)


def player_refusal(state, command, target, count, expected):
    """Why a command is refused, or None."""
    status, loaded, has_range, frame, armed, generation, start, end = state
    if command == "Snapshot":
        return None
    if expected is not None and expected != generation:
        return "StaleGeneration"
    if command == "LoadPreparedInput":
        return "SourceAlreadyLoaded" if loaded else None
    if not loaded:
        return "SourceNotLoaded"
    if command in ("Cue", "Seek") or (command == "Preroll" and target is not None):
        if not has_range:
            return "PrepareRequired"
        return None if start <= target < end else f"{'Seek' if command == 'Seek' else 'Cue'}OutsideActiveRange"
    if command == "Preroll":
        return "PrepareRequired" if frame is None else None
    if command == "Play":
        if (status == "Playing" and count is not None) or (armed and status in ("Ready", "Paused")):
            return None
        return "PrepareRequired" if status in ("Loaded", "Ready", "Paused") else "IllegalCommandForState"
    if command == "Pause" and status != "Playing":
        return "IllegalCommandForState"
    return None


def player_apply(state, command, target, count, given):
    """State after an accepted command; ``given`` is the range that Prepare makes active. Snapshot changes nothing."""
    status, loaded, has_range, frame, armed, generation, start, end = state
    if command == "Snapshot":
        return state
    if command == "LoadPreparedInput":
        status, loaded, has_range, frame, armed, start, end = "Loaded", True, False, None, False, None, None
    elif command == "Prepare":
        has_range, armed, (start, end) = True, armed or frame is not None, given
    elif command == "Cue":
        status, frame, armed = "Ready", target, True
    elif command == "Preroll":
        frame, armed = frame if target is None else target, True
    elif command == "Play":
        status, frame = "Playing", frame + (count or 0)
        if frame >= end:
            status, frame, armed = "Completed", end - 1, False
    elif command == "Pause":
        status = "Paused"
    elif command == "Seek":
        frame, armed = target, False
    elif command == "Stop":
        status, armed = "Stopped", False
    elif command == "Unload":
        status, loaded, has_range, frame, armed, start, end = "Empty", False, False, None, False, None, None
    return status, loaded, has_range, frame, armed, generation + 1, start, end


def player() -> Machine:
    """Commands of a session against the player; a row carries the range of the session's input."""

    def step(state, row):
        seq, command, target, count, expected, *given = row
        reason = player_refusal(state, command, target, count, expected)
        if reason is None:
            state = player_apply(state, command, target, count, given)
        return state, [(seq, command, reason is None, reason, *state)]

    return Machine(PLAYER_STATE, PLAYER_START, PLAYER_INPUTS, PLAYER_OUT, step, probe=lambda: PlayerProbe(step))


# ---- runtime lifecycle --------------------------------------------------------------------------


LIFECYCLE = ("Idle", "Preparing", "Ready", "Playing", "Paused", "Draining", "Completed", "Failed")


def lifecycle() -> Machine:
    """Idle, Preparing, Ready, Playing, Paused, Draining, Completed, Failed.

    Prepare carries whether the media facts hold and whether the preroll is ready. Completed and Failed
    end a run; only a new session leaves them.
    """
    allowed = {
        "Play": ({"Ready", "Paused"}, "Playing"),
        "Pause": ({"Playing"}, "Paused"),
        "Seek": ({"Ready", "Playing", "Paused"}, None),
        "Stop": ({"Ready", "Playing", "Paused"}, "Completed"),
        "Drain": ({"Playing", "Paused"}, "Draining"),
        "Drained": ({"Draining"}, "Completed"),
    }

    def step(state, row):
        status, run = state
        seq, op, facts_ok, preroll_ready = row
        accepted = True
        if op == "NewSession":
            status, run = "Idle", run + 1
        elif op == "Prepare":
            accepted = status in ("Idle", "Preparing")
            if accepted:
                status = "Failed" if not facts_ok else "Ready" if preroll_ready else "Preparing"
        else:
            legal, target = allowed[op]
            accepted = status in legal
            if accepted and target is not None:
                status = target
        return (status, run), [(seq, op, accepted, status, run)]

    return Machine(
        "status string, run bigint", ("Idle", 0), ("seq", "op", "facts_ok", "preroll_ready"),
        "seq bigint, op string, accepted boolean, status string, run bigint", step,
        probe=lambda: ControlProbe(step, 1, [(s, 0) for s in LIFECYCLE]))


# ---- source lifecycle ---------------------------------------------------------------------------


def _source_starts():
    """Every state of a source slot but for its cue, revision and range, which are unknown."""
    unknown = (0, _FAR, _FAR)
    yield False, False, False, False, None, False, False, *unknown
    for preloaded in (False, True):
        yield True, preloaded, False, False, None, False, False, *unknown
        for playing in (False, True) if preloaded else (False,):
            for ranged, cue, anchored in ((False, None, False), (True, None, False), (True, _FAR, False), (True, _FAR, True)):
                if preloaded or not anchored:
                    yield True, preloaded, True, ranged, cue, anchored, playing, *unknown


SOURCE_STARTS = tuple(_source_starts())


def source_lifecycle() -> Machine:
    """Load, preload, activate, range, cue, anchor and play-ready of one source slot, with revisions.

    A row carries the range of the session's input, which set_active_range makes active.

    A command naming a stale handle is rejected. Unload clears everything and invalidates the revision;
    close clears the active state and keeps the source loaded.
    """

    def step(state, row):
        loaded, preloaded, active, ranged, cue, anchored, playing, revision, start, end = state
        seq, sub, op, target, stale, *given = row
        ready = active and preloaded and ranged and cue is not None and anchored
        if op == "load_source":
            ok = not loaded
            if ok:
                loaded, revision = True, revision + 1
        elif stale or not loaded:
            ok = False
        elif op == "preload_source":
            ok = preloaded = True
        elif op == "set_active_source":
            ok = active = True
            ranged, cue, anchored, playing = False, None, False, False
        elif op == "unload_source":
            ok = True
            loaded = preloaded = active = ranged = anchored = playing = False
            cue = None
        elif not active:
            ok = False
        elif op == "set_active_range":
            ok = ranged = True
            cue, anchored, (start, end) = None, False, given
        elif op == "cue_frame":
            ok = ranged and start <= target < end
            if ok:
                cue, anchored = target, False
        elif op == "prepare_anchor":
            ok = preloaded and cue is not None
            anchored = anchored or ok
        elif op == "play":
            ok = ready
            playing = playing or ok
        elif op in ("pause", "stop"):
            ok = playing
            playing = False
        else:  # close_active_source
            ok = True
            active = ranged = anchored = playing = False
            cue = None
        ready = active and preloaded and ranged and cue is not None and anchored
        state = (loaded, preloaded, active, ranged, cue, anchored, playing, revision, start, end)
        return state, [(seq, sub, op, ok, loaded, active, cue, ready, playing, revision)]

    return Machine(
        "loaded boolean, preloaded boolean, active boolean, ranged boolean, cue bigint, anchored boolean, playing boolean, "
        "revision bigint, range_start bigint, range_end bigint",
        (False, False, False, False, None, False, False, 0, None, None),
        ("seq", "sub", "op", "target", "stale", "range_start", "range_end"),
        "seq bigint, sub int, op string, accepted boolean, loaded boolean, active boolean, cue bigint, play_ready boolean, "
        "playing boolean, revision bigint", step,
        probe=lambda: ControlProbe(step, 7, SOURCE_STARTS, registers=(4,), assumed=(3, (8, 9), (5, 6))))


# ---- coverage cursor ----------------------------------------------------------------------------


def coverage(frames_per_chunk: int = 25, samples_per_frame: int = 960) -> Machine:
    """Which ticks submit audio: a submitted range stays covered until a seek or stop resets it."""

    def step(state, row):
        covered, submitted, submissions = state
        seq, op, frame = row
        start = frame * samples_per_frame
        if op == "reset":
            covered, label = 0, "reset"
        elif start < covered:
            label = "covered" if submitted else "pending"
        else:
            covered, submitted, submissions, label = start + frames_per_chunk * samples_per_frame, True, submissions + 1, "submitted"
        return (covered, submitted, submissions), [(seq, label, covered, submissions)]

    return Machine(
        "covered bigint, submitted boolean, submissions bigint", (0, False, 0), ("seq", "op", "frame"),
        "seq bigint, label string, covered_until bigint, submissions bigint", step,
        probe=lambda: CoverageProbe(step, samples_per_frame))
