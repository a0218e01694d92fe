"""The cell kernel: all vertices and unbounded edges of a group of cells, in numpy.

A vertex is where generators are equally near and planes are met; its signature
names them. In general position a signature has d + 1 members, and leaving one out
gives an edge that starts there. The kernel walks these edges, a whole frontier of
vertices at a time: directions are columns of the inverse of the members'
differences, the end of an edge is the first bisector or plane in that direction,
found for all edges of the frontier by two matrix products. A vertex that several
cells of the group share is made once. Where more than d + 1 members meet within
tolerance, edges are the extreme rays of each cell's cone.

Vertices and edges that were seen are told by 64-bit sums of random numbers, one
for each member.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np

TOL = 1e-9
#: Numbers in a table of edges by members.
TABLE = 1 << 18


class NoVertex(ValueError):
    """The half-spaces have no vertex: fewer than d of them are independent."""


def first_vertex(a: np.ndarray, b: np.ndarray, tol: float, seed: int = 0) -> np.ndarray:
    """A vertex of {y : a y <= b} by d casts from 0, each within the planes hit so far; rows of a are unit normals."""
    d = a.shape[1]
    rng = np.random.default_rng(seed)
    for _ in range(8):
        x, basis = np.zeros(d), np.eye(d)
        while basis.shape[1]:
            u = basis @ rng.standard_normal(basis.shape[1])
            u /= np.linalg.norm(u)
            slope, slack = a @ u, b - a @ x
            for sign in (1, -1):
                s = sign * slope
                t = np.where(s > 1e-10, slack / np.where(s > 1e-10, s, 1), np.inf)
                if len(t) and np.isfinite(hit := t.min()):
                    break
            else:
                break
            x = x + max(hit, 0.0) * sign * u
            n = basis.T @ a[int(t.argmin())]
            basis = basis @ np.linalg.svd(n[None, :])[2][1:].T
        else:
            return x
    raise NoVertex("fewer than d independent half-spaces")


def cone_rays(n: np.ndarray) -> list[tuple[np.ndarray, tuple[int, ...]]]:
    """(direction, rows that stay tight) of the extreme rays of {u : n u <= 0}."""
    m, d = n.shape
    out: dict[tuple[int, ...], np.ndarray] = {}
    for rows in combinations(range(m), d - 1):
        if d == 1:
            candidates = [np.ones(1), -np.ones(1)]
        else:
            _, s, v = np.linalg.svd(n[list(rows)])
            if s[-1] < 1e-9:
                continue
            candidates = [v[-1], -v[-1]]
        for u in candidates:
            slope = n @ u
            if (slope <= 1e-9).all():
                out.setdefault(tuple(np.flatnonzero(slope > -1e-9).tolist()), u)
    return [(u, t) for t, u in out.items()]


@dataclass
class Group:
    """What the walk found. Members are places: generators first, then planes; each signature is sorted."""

    plain: np.ndarray  # signatures of d + 1 members
    points: np.ndarray
    wide: list[np.ndarray] = field(default_factory=list)  # signatures of more members
    wide_points: list[np.ndarray] = field(default_factory=list)
    rays: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # members, origin, direction


class Walk:
    """Cells of the generators at the places ``own`` among all ``points``, within the planes."""

    def __init__(self, own: np.ndarray, points: np.ndarray, bases: np.ndarray, normals: np.ndarray, tol: float = TOL):
        self.n, self.d = points.shape
        self.tol, self.own = tol, own
        self.origin = points[own].mean(axis=0)
        x = points - self.origin
        self.scale = float(np.median(np.linalg.norm(x, axis=1))) or float(np.abs(x).max()) or 1.0
        x = x / self.scale
        # Rows of generators and planes: a member's slack at y is h - a.y, less the same of a generator of the signature if it is one itself.
        self.a = np.concatenate([x, normals.reshape(-1, self.d)])
        offsets = ((bases.reshape(-1, self.d) - self.origin) * normals.reshape(-1, self.d)).sum(axis=1) / self.scale
        self.h = np.concatenate([(x * x).sum(axis=1) / 2, offsets])
        # Columns that give slacks and slopes of all members by one product each.
        self.table = np.concatenate([self.a, self.h[:, None], (np.arange(len(self.a)) < self.n)[:, None]], axis=1).T.copy()
        self.close = self.tol * 4 * float(np.abs(x).max()) * self.d**0.5
        self.mine = np.zeros(len(self.a), bool)
        self.mine[own] = True
        self.name = np.random.default_rng(len(self.a)).integers(1, 2**63, len(self.a), dtype=np.uint64)
        self.walked: set[int] = set()
        self.seen: set[int] = set()
        self.plain, self.points, self.found = [], [], Group(np.zeros((0, self.d + 1), np.int64), np.zeros((0, self.d)))

    def cells(self) -> Group:
        covered = np.zeros(len(self.a), bool)
        for g in self.own:
            if covered[g]:
                continue
            before = len(self.plain), len(self.found.wide)
            self._walk(g)
            for s in [*self.plain[before[0] :], *self.found.wide[before[1] :]]:
                covered[s.reshape(-1)] = True
            covered[g] = True
        out = self.found
        if self.plain:
            out.plain, out.points = np.concatenate(self.plain), np.concatenate(self.points)
        out.points = out.points * self.scale + self.origin
        out.wide_points = [p * self.scale + self.origin for p in out.wide_points]
        out.rays = [(s, p * self.scale + self.origin, u) for s, p, u in out.rays]
        return out

    # -- places near one point --

    def _half_spaces(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit normals, offsets) about generator g of all members; its own row is 0 <= 1."""
        a, b = self.a.copy(), self.h - self.a @ self.a[g]
        a[: self.n] -= self.a[g]
        b[: self.n] += (self.a[g] ** 2).sum() - self.h[g]
        size = np.linalg.norm(a[: self.n], axis=1)
        size[g] = 1.0
        if (size == 0).any():
            raise ValueError("two generators coincide")
        a[: self.n] /= size[:, None]
        b[: self.n] /= size
        b[g] = 1.0
        return a, b

    def _settled(self, g: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(members, point): what is tight at y, a point of g's cell, and y solved again from that."""
        a, b = self._half_spaces(g)
        z = y - self.a[g]
        on = np.abs(b - a @ z) <= 10 * self.tol
        if on.any():
            z = z + np.linalg.lstsq(a[on], b[on] - a[on] @ z, rcond=None)[0]
        on = np.abs(b - a @ z) <= self.tol
        on[g] = True
        return np.flatnonzero(on), z + self.a[g]

    def _register(self, members: np.ndarray, y: np.ndarray, plain: list, wide: list) -> None:
        key = int(self.name[members].sum())
        if key not in self.seen:
            self.seen.add(key)
            (plain if len(members) == self.d + 1 else wide).append((members, y))

    # -- the walk --

    def _walk(self, g: int) -> None:
        a, b = self._half_spaces(g)
        members, y = self._settled(g, self.a[g] + first_vertex(a, b, self.tol))
        plain, wide = [], []
        self._register(members, y, plain, wide)
        s = np.array([m for m, _ in plain], np.int64).reshape(-1, self.d + 1)
        v = np.array([p for _, p in plain]).reshape(-1, self.d)
        while len(s) or wide:
            if len(s):
                self.plain.append(s)
                self.points.append(v)
            for m, p in wide:
                self.found.wide.append(m)
                self.found.wide_points.append(p)
            more_s, more_v, more = [], [], []
            for edges in (self._plain_edges(s, v) if len(s) else None, self._wide_edges(wide) if wide else None):
                if edges is not None and len(edges[1]):
                    self._follow(*edges, more_s, more_v, more)
            s = np.concatenate(more_s) if more_s else np.zeros((0, self.d + 1), np.int64)
            v = np.concatenate(more_v) if more_v else np.zeros((0, self.d))
            wide = more

    def _new(self, keys: np.ndarray, known: set[int]) -> np.ndarray:
        """Places of the first rows of each key that isn't known; they are from now on."""
        names, first = np.unique(keys, return_index=True)
        fresh = np.array([k not in known for k in names.tolist()], bool)
        known.update(names[fresh].tolist())
        return first[fresh]

    def _rows(self, s: np.ndarray, x0: np.ndarray) -> np.ndarray:
        """Differences of members to a generator each; normals of planes."""
        return self.a[s] - np.where((s < self.n)[..., None], self.a[x0][:, None, :], 0.0)

    def _plain_edges(self, s: np.ndarray, v: np.ndarray):
        """(support, start, direction, generator of the support, members at the start) of edges that weren't walked."""
        d, n = self.d, self.n
        inverse = np.linalg.inv(self._rows(s[:, 1:], s[:, 0]))
        u = -np.swapaxes(inverse, 1, 2)
        # Without the first member, the others move away from it all alike.
        away = np.einsum("kij,kj->ki", inverse, (s[:, 1:] < n).astype(float))
        u = np.concatenate([away[:, None, :], u], axis=1)
        keep = np.array([[j for j in range(d + 1) if j != m] for m in range(d + 1)])
        support = s[:, keep]
        x0 = support[:, :, 0]
        keys = self.name[s].sum(axis=1)[:, None] - self.name[s]
        at, omit = np.nonzero((x0 < n) & self.mine[support].any(axis=2))
        new = self._new(keys[at, omit], self.walked)
        at, omit = at[new], omit[new]
        return support[at, omit], v[at], u[at, omit], x0[at, omit], s[at]

    def _wide_edges(self, wide: list):
        rows = []
        for members, p in wide:
            for g in members[self.mine[members]]:
                others = members[members != g]
                normals = self._rows(others[None, :], np.array([g]))[0]
                normals = normals / np.linalg.norm(normals, axis=1)[:, None]
                for u, tight in cone_rays(normals):
                    support = np.sort(np.append(others[list(tight)], g))
                    key = int(self.name[support].sum())
                    if key not in self.walked:
                        self.walked.add(key)
                        rows.append((support, p, u, g, members))
        if not rows:
            return None
        return [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), [r[4] for r in rows]

    def _slacks(self, y: np.ndarray, x0: np.ndarray) -> np.ndarray:
        """Slack of every member at points y that generators x0 are nearest to."""
        return np.concatenate([-y, np.ones((len(y), 1)), ((y * self.a[x0]).sum(axis=1) - self.h[x0])[:, None]], axis=1) @ self.table

    def _cast(self, v: np.ndarray, u: np.ndarray, x0: np.ndarray, start) -> tuple[np.ndarray, np.ndarray]:
        """(member that each edge meets first, distance): the largest slope per slack, as slacks are positive beside the members at the start."""
        slope = np.concatenate([u, np.zeros((len(u), 1)), -(u * self.a[x0]).sum(axis=1)[:, None]], axis=1) @ self.table
        slack = self._slacks(v, x0)
        if isinstance(start, np.ndarray):
            np.put_along_axis(slope, start, 0.0, axis=1)
            np.put_along_axis(slack, start, 1.0, axis=1)
        else:
            for i, members in enumerate(start):
                slope[i, members], slack[i, members] = 0.0, 1.0
        np.divide(slope, slack, out=slope)
        best = slope.argmax(axis=1)
        top = slope[np.arange(len(v)), best]
        with np.errstate(divide="ignore"):
            return best, np.where(top > 1e-11, 1 / top, np.inf)

    def _follow(self, support, v, u, x0, start, more_s: list, more_v: list, more_wide: list) -> None:
        """Casts all edges and registers what they end at."""
        u = u / np.linalg.norm(u, axis=1)[:, None]
        step = max(1, TABLE // len(self.a))
        ends = [self._cast(v[k : k + step], u[k : k + step], x0[k : k + step], start[k : k + step]) for k in range(0, len(v), step)]
        best, far = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
        finite = np.isfinite(far)
        for i in np.flatnonzero(~finite):
            self.found.rays.append((np.asarray(support[i]), v[i], u[i]))
        plain = np.flatnonzero(finite & (True if isinstance(support, np.ndarray) else np.array([len(m) == self.d for m in support])))
        rest = list(np.flatnonzero(finite & ~np.isin(np.arange(len(v)), plain)))
        if len(plain):
            own = support[plain] if isinstance(support, np.ndarray) else np.array([support[i] for i in plain])
            s = np.sort(np.concatenate([own, best[plain, None]], axis=1), axis=1)
            new = self._new(self.name[s].sum(axis=1), self.seen)
            s, i = s[new], plain[new]
            for k in range(0, len(s), step):
                rest += self._solved(s[k : k + step], v[i[k : k + step]] + far[i[k : k + step], None] * u[i[k : k + step]], i[k : k + step], more_s, more_v)
        found: list = []
        for i in rest:
            members, y = self._settled(int(x0[i]), v[i] + far[i] * u[i])
            if len(members) > self.d:
                self._register(members, y, found, more_wide)
        if found:
            more_s.append(np.array([m for m, _ in found]))
            more_v.append(np.array([p for _, p in found]))

    def _solved(self, s: np.ndarray, y: np.ndarray, edge: np.ndarray, more_s: list, more_v: list) -> list:
        """Solves signatures for their points; returns the edges at whose ends other members are near, too."""
        rows, inside = self._rows(s[:, 1:], s[:, 0]), s[:, 1:] < self.n
        offset = self.h[s[:, 1:]] - np.where(inside, self.h[s[:, 0]][:, None], 0.0)
        y = y + np.linalg.solve(rows, (offset - np.einsum("kij,kj->ki", rows, y))[:, :, None])[:, :, 0]
        alone = (self._slacks(y, s[:, 0]) <= self.close).sum(axis=1) == self.d + 1
        more_s.append(s[alone])
        more_v.append(y[alone])
        # What is settled again may turn out to be this signature after all.
        self.seen.difference_update(self.name[s[~alone]].sum(axis=1).tolist())
        return list(edge[~alone])


def reach_of(group: Group, own: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Twice the distance to the farthest vertex of each own cell: no generator farther away cuts it; infinite for unbounded ones."""
    far = np.zeros(len(points))
    n = len(points)
    for k in range(group.plain.shape[1]):
        s = group.plain[:, k]
        some = s < n
        np.maximum.at(far, s[some], np.linalg.norm(group.points[some] - points[s[some]], axis=1))
    for s, p in zip(group.wide, group.wide_points, strict=True):
        s = s[s < n]
        far[s] = np.maximum(far[s], np.linalg.norm(points[s] - p, axis=1))
    for s, _, _ in group.rays:
        far[s[s < n]] = np.inf
    return 2 * far[own]
