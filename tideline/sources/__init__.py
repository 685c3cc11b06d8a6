"""Readers of irregular inputs: spreadsheet grids, pages of links, catalogues."""
