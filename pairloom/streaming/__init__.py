"""Arriving catalogs: each batch's catalog is linked with the one before."""
