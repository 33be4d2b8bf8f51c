import importlib.util
import pathlib
import sys

spec = importlib.util.spec_from_file_location("llm_helpers", pathlib.Path(__file__).with_name("helpers.py"))
sys.modules["llm_helpers"] = importlib.util.module_from_spec(spec)
spec.loader.exec_module(sys.modules["llm_helpers"])
