"""Bindings to the shared tables and the registered queries."""


def registered():
    import importlib
    import pkgutil

    from talkmill.plans import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.SQL
