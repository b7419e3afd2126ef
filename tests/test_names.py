"""No module binds a name twice: the second would silently replace what other code refers to."""

import ast
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("path", sorted((ROOT / "marginalia").rglob("*.py")), ids=lambda p: str(p.relative_to(ROOT)))
def test_module_level_names_are_bound_once(path):
    bound = Counter()
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            bound[node.name] += 1
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            bound.update(n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store))
    assert [n for n, times in bound.items() if times > 1] == []
