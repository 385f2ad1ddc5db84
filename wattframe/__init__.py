"""Distribution-network analytics on Spark."""

_WHERE = {
    "network": "Network Builder sample",
    "errors": "WattError SyntaxProblem NameProblem ParameterProblem UnitProblem DataProblem RefreshRefused",
    "config": "Config find_config load_config project_config",
    "plans.language": "parse parse_script bind",
    "plans.compiler": "execute execute_script explain",
    "render": "render render_script",
    "operators.validate": "validate",
    "sources.csv_files": "read_csv write_csv",
    "sources.cim": "read_cim write_cim",
    "sources.dss": "read_dss loads_dss",
    "sources.sqlite_files": "read_sqlite write_sqlite",
    "sources.tables": "read_folder read_mapped read_postgres",
    "streaming.switching": "follow",
}
_FROM = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_FROM)


def __getattr__(name: str):
    """Names of the library's parts, imported on first use: Python workers import this package too."""
    if name not in _FROM:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"wattframe.{_FROM[name]}"), name)
