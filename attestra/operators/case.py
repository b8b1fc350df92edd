"""What one assessment reads: declarations on the driver, records as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class RunError(ValueError):
    """A run that can't be evaluated at all; ``code`` names the reason."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Declared:
    """A dataset's own claim about its coverage."""

    coverage: str
    basis: tuple[str, ...]
    consistency: str = "not_applicable"


@dataclass(frozen=True)
class Pack:
    """A requirement pack: what evidence each activity needs and how approvals bind."""

    project_id: str
    scope_revision: str
    requirements: dict[str, tuple[str, ...]]
    accepted_bases: tuple[tuple[str, ...], ...]
    binding: str = "digest"  # or revisions
    evidence_scheme: str | None = None  # the tag in evidence digests; this engine's own if unset
    effective_from: str | None = None  # canonical UTC text


@dataclass(frozen=True)
class Case:
    """``raw`` holds a DataFrame of string cells for each dataset, ``files`` the probed evidence
    (relative_path, status, sha256)."""

    raw: dict[str, DataFrame]
    files: DataFrame
    pack: Pack
    project_id: str
    as_of: str  # canonical UTC text
    declared: dict[str, Declared | None] = field(default_factory=dict)
    scope_revision: str | None = None
    scope_accepted: bool = True
    unmapped: DataFrame | None = None

    def guard(self) -> None:
        """Raise if the pack is another project's or not yet effective; canonical times compare as text."""
        if self.project_id != self.pack.project_id:
            raise RunError("PROJECT_MISMATCH", f"the records are of {self.project_id}, the pack is of {self.pack.project_id}")
        if self.pack.effective_from is not None and self.as_of < self.pack.effective_from:
            raise RunError("POLICY_NOT_EFFECTIVE", f"{self.as_of} is before {self.pack.effective_from}")

    @property
    def scope_present(self) -> bool:
        return "scope" in self.raw

    def is_declared_complete(self, dataset: str) -> bool:
        claim = self.declared.get(dataset)
        return claim is not None and claim.coverage == "complete_for_declared_scope"
