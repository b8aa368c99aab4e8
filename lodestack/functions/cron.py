"""Five-field cron expressions: validity and next run."""

from __future__ import annotations

from datetime import datetime, timedelta

RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
NAMES = {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}


def _field(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        body, _, step = part.partition("/")
        if step and not (step.isdigit() and int(step) > 0):
            raise ValueError(part)
        a, dash, b = body.partition("-")
        first, last = (low, high) if body == "*" else (_number(a), _number(b) if dash else (high if step else _number(a)))
        if not low <= first <= last <= high:
            raise ValueError(part)
        out |= set(range(first, last + 1, int(step or 1)))
    return out


def _number(text: str) -> int:
    return NAMES[text] if text in NAMES else int(text)


def parse(expression: str) -> list[set[int]]:
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    try:
        sets = [_field(f, *r) for f, r in zip(fields, RANGES, strict=True)]
    except (ValueError, KeyError) as e:
        raise ValueError(f"bad field: {e}") from e
    sets[4] = {d % 7 for d in sets[4]}
    return sets


def is_valid(expression: str) -> bool:
    try:
        parse(expression)
    except ValueError:
        return False
    return True


def next_run(expression: str, after: datetime) -> datetime | None:
    """The first minute after ``after`` that matches; day of month and day of week are alternatives when both are given."""
    minute, hour, day, month, week = parse(expression)
    free_day, free_week = len(day) == 31, len(week) == 7
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    end = after + timedelta(days=366 * 5)
    while at < end:
        by_day, by_week = at.day in day, (at.weekday() + 1) % 7 in week
        fits = by_day and by_week if free_day or free_week else by_day or by_week
        if at.month not in month or not fits:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hour:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    return None


def shift_to_utc(expression: str, offset_minutes: int) -> str:
    """Plain hour and minute of a local time zone in UTC; days stay as they are, other expressions too."""
    minute, hour, *rest = expression.split()
    if not (minute.isdigit() and hour.isdigit()):
        return expression
    at = (int(hour) * 60 + int(minute) - offset_minutes) % 1440
    return " ".join([str(at % 60), str(at // 60), *rest])
