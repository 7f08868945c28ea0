"""Every threshold, word list and weight in one place, so that a run can override any of them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # ledger
    amount_tolerance: float = 0.01
    # similarity of key texts
    similarity_threshold: float = 0.6
    # column-name similarity
    column_cutoff: float = 0.72
    column_containment_score: float = 0.85
    synonym_containment_score: float = 0.9
    synonym_containment_length: int = 6
    assignment_accept: float = 0.40
    # data type of a table pair
    transactional_duplicate_ratio: float = 0.02
    key_uniqueness: float = 0.9
    date_parse_ratio: float = 0.8
    unnamed_fill_ratio: float = 0.1
    # validators
    validator_min_samples: int = 3
    validator_threshold: float = 0.7
    id_uniqueness: float = 0.9
    id_charset: float = 0.9
    # paging
    page_sizes: tuple = (25, 50, 100, 250)
    page_size: int = 50
    # pages that end beyond this many rows are read from a sorted table
    top_rows: int = 100_000
    # text chunks
    chunk_chars: int = 800
    # Percent below which a churn label holds; the labels are free
    churn_steps: tuple = (
        (5, "very few changes"),
        (15, "few changes"),
        (35, "some changes"),
    )
    churn_last: str = "many changes"
    # Weights of the eight signals of a column pair
    signal_weights: dict = field(
        default_factory=lambda: {
            "header_similarity": 0.25,
            "datatype_compatibility": 0.15,
            "value_overlap": 0.20,
            "pattern_similarity": 0.10,
            "profile_similarity": 0.10,
            "semantic_similarity": 0.10,
            "uniqueness_compatibility": 0.05,
            "null_compatibility": 0.05,
        }
    )
    # scale: a group above this many rows is ranked in slices of this many rows
    hot_group_rows: int = 1_000_000
    # accuracy of medians (relative rank error is 1 / accuracy)
    median_accuracy: int = 100_000


DEFAULTS = Settings()

# Names tried as business keys, in order of preference.
KEY_NAMES = (
    "id", "key", "record_id", "transaction_id", "customer_id", "account_id",
    "invoice_id", "order_id", "employee_id", "product_id", "ref_id", "case_id",
    "claim_id", "policy_id", "loan_id", "contract_id", "project_id", "ticket_id",
    "ref", "code", "no", "num", "number", "seq", "serial",
    "invoice_no", "invoice_number", "order_no", "order_number",
    "txn_id", "txn", "trx_id", "trx", "trans_id",
    "emp_id", "cust_id", "acct_id", "proj_id",
    "invoice no", "invoice number", "order no", "order number",
    "transaction id", "customer id", "account id", "employee id",
    "project name", "project id", "reference", "reference no",
    "reference number", "ref no", "ref number",
    "unique id", "unique key", "primary key",
)

# Date column names tried in order.
DATE_NAMES = ("date", "transaction_date", "transactiondate", "created_at", "createdat")

# Words that make a column name look transactional, and the subset that identifies a document.
TRANSACTION_WORDS = (
    "transaction", "invoice", "order", "payment", "amount", "debit", "credit",
    "balance", "date", "journal", "document",
)
DOCUMENT_WORDS = ("transaction", "invoice", "order", "payment", "journal", "document")

# Words that make a column name look like money (line mode and report mode).
AMOUNT_WORDS = ("amount", "amt", "value", "total", "price", "sum", "debit", "credit")
REPORT_AMOUNT_WORDS = (
    "amount", "amt", "income", "revenue", "value", "total", "price", "sum",
    "debit", "credit", "balance",
)

# Column-name hints of an identifier.
KEY_SCORE_HINTS = ("id", "num", "number", "code", "key", "no")
BUSINESS_KEY_HINTS = ("id", "key", "code", "no", "number")

# Texts that mean "no value".
NULL_WORDS = ("nan", "none", "<na>", "")

# Texts of a boolean column.
BOOLEAN_WORDS = ("true", "false", "1", "0", "yes", "no", "y", "n", "t", "f")

# Target choices that mean "skip this source column".
IGNORE_MARKS = ("__ignore__", "-- Ignore / Skip --")

# Normalised headers of due-date/aging columns and of customer columns.
DUE_NAMES = ("duedate", "paymentduedate", "aging", "agingdays", "paymentterms")
CUSTOMER_NAMES = ("customer", "customername", "clientname", "accountname")

# Which canonical fields have a recognisable datatype.
FIELD_VALIDATORS = {
    "TxnDate": "date", "DueDate": "date",
    "Amount": "numeric", "CreditLimit": "numeric",
    "Email": "email", "Phone": "phone", "Currency": "currency",
    "TxnNumber": "identifier", "CustomerID": "identifier",
    "PONumber": "identifier", "TaxID": "identifier",
}

# Patterns of the validators.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_PATTERN = r"^\+?[0-9()\-.\s]{7,20}$"
CURRENCY_PATTERN = r"^[A-Za-z]{3}$"
IDENTIFIER_PATTERN = r"^[A-Za-z0-9\-_/#]+$"
STRICT_NUMBER_PATTERN = r"^-?[0-9,]*\.?[0-9]+$"
