"""Ledger, voucher and tax-return analytics as DataFrame functions on Spark SQL."""
