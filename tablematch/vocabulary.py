"""Canonical fields and the header words that stand for them.

A vocabulary is {family: {field: [normalised header, …]}}. Pass your own (for instance read from a JSON file) to cover
other systems; the default is built from a few stems and endings.
"""

from __future__ import annotations

import json

TRANSACTIONAL = (
    "TxnNumber", "TxnType", "TxnDate", "Amount", "Customer", "PONumber", "DueDate", "Salesperson", "Currency", "Status",
)
MASTER = (
    "CustomerID", "AccountName", "TaxID", "BillingAddress", "CustomerType", "CreditLimit", "Phone", "Email", "Country",
    "Status",
)

_DOCUMENTS = ("transaction", "txn", "trx", "invoice", "document", "doc", "order", "receipt", "voucher", "bill")
_PARTIES = ("customer", "client", "account", "party")


def _ends(stems: tuple, endings: tuple) -> list[str]:
    return [s + e for e in endings for s in stems]


def default_vocabulary() -> dict[str, dict[str, list[str]]]:
    return {
        "transactional": {
            "TxnNumber": _ends(_DOCUMENTS, ("number", "no", "id")) + ["reference", "ref", "refno", "refnumber", "referencenumber", "invoice", "number", "no", "id"],
            "TxnType": _ends(_DOCUMENTS, ("type",)) + ["type", "category"],
            "TxnDate": _ends(_DOCUMENTS, ("date",)) + ["date", "postingdate", "issuedate", "entrydate"],
            "Amount": _ends(_DOCUMENTS, ("amount", "total")) + ["amount", "total", "balance", "value", "totalamount", "grandtotal", "amountdue", "balancedue", "openbalance", "openamount", "netamount"],
            "Customer": _ends(_PARTIES, ("name", "")) + ["name", "company"],
            "PONumber": ["ponumber", "pono", "po", "purchaseorder"],
            "DueDate": ["duedate", "paymentduedate", "due"],
            "Salesperson": ["salesperson", "salesrep", "agent"],
            "Currency": ["currency", "currencycode"],
            "Status": ["status", "state"],
        },
        "master": {
            "CustomerID": _ends(_PARTIES, ("id", "number", "no")) + ["id"],
            "AccountName": _ends(_PARTIES, ("name",)) + ["name", "company"],
            "TaxID": ["taxid", "taxnumber", "vatid"],
            "BillingAddress": ["billingaddress", "address", "street"],
            "CustomerType": _ends(_PARTIES, ("type",)) + ["segment", "category"],
            "CreditLimit": ["creditlimit", "creditline"],
            "Phone": ["phone", "phonenumber", "telephone", "mobile"],
            "Email": ["email", "emailaddress"],
            "Country": ["country", "countrycode", "nation"],
            "Status": ["status", "active", "state"],
        },
    }


def load_vocabulary(path: str) -> dict[str, dict[str, list[str]]]:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def words_of(fields: dict[str, list[str]]) -> set[str]:
    return {w for words in fields.values() for w in words}
