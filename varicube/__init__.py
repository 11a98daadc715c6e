"""varicube: category-wide case/control burden analysis as Spark DataFrame jobs."""

from varicube.domain import CategoryDomain
from varicube.session import build_session, tune

__all__ = ["CategoryDomain", "build_session", "tune"]
__version__ = "0.1.0"
