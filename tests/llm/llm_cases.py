"""Folders and texts that the tests of this folder share."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
LONG = "lorem ipsum dolor " * 40_000
