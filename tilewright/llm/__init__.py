"""Operators for preparing training text; nothing else in tilewright imports this subpackage."""
