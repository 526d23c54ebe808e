"""The fixtures' rows, for import by the tests of this folder."""

from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("llm_rows", Path(__file__).with_name("conftest.py"))
_rows = util.module_from_spec(_spec)
_spec.loader.exec_module(_rows)
LONG, ODD, CLASHING, frame = _rows.LONG, _rows.ODD, _rows.CLASHING, _rows.frame
