"""Operators over ledgers, statements, tables, vouchers, tax registers and receipts."""
