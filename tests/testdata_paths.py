"""Folders of the given tables. In a module of its own: ``conftest`` is the name of two files."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
