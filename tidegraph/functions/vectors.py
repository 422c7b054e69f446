"""SQL text for small vectors in three dimensions; a vector is three expressions."""

from __future__ import annotations

Vector = tuple[str, str, str]


def vector(prefix: str) -> Vector:
    return (f"{prefix}x", f"{prefix}y", f"{prefix}z")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(f"({p} - {q})" for p, q in zip(a, b))  # type: ignore[return-value]


def plus(a: Vector, b: Vector, factor: str = "1d") -> Vector:
    return tuple(f"({p} + {factor} * {q})" for p, q in zip(a, b))  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def cross(a: Vector, b: Vector) -> Vector:
    return (
        f"({a[1]} * {b[2]} - {a[2]} * {b[1]})",
        f"({a[2]} * {b[0]} - {a[0]} * {b[2]})",
        f"({a[0]} * {b[1]} - {a[1]} * {b[0]})",
    )


def length(a: Vector) -> str:
    return f"sqrt({dot(a, a)})"


def to_segment(p: Vector, a: Vector, b: Vector) -> str:
    """Distance of a point to a segment, to its start if both ends coincide."""
    d = minus(b, a)
    along = f"greatest(0d, least(1d, coalesce(try_divide({dot(minus(p, a), d)}, {dot(d, d)}), 0d)))"
    return length(minus(p, plus(a, d, along)))


def to_triangle(p: Vector, a: Vector, b: Vector, c: Vector, n: Vector) -> str:
    """Distance to a triangle with normal ``n``: to its plane above it, else to its sides."""
    above = " AND ".join(
        f"{dot(cross(minus(q, o), minus(p, o)), n)} >= 0" for o, q in ((a, b), (b, c), (c, a))
    )
    plane = f"abs({dot(minus(p, a), n)}) / {length(n)}"
    sides = ", ".join(to_segment(p, o, q) for o, q in ((a, b), (b, c), (c, a)))
    return f"CASE WHEN {above} THEN {plane} ELSE least({sides}) END"


def to_sides(p: Vector, a: Vector, b: Vector, c: Vector) -> str:
    return f"least({', '.join(to_segment(p, o, q) for o, q in ((a, b), (b, c), (c, a)))})"
