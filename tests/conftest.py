from __future__ import annotations

import pytest

from sealtrail.profile import SealProfile
from sealtrail.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def profile():
    return SealProfile(key_sha256="ab" * 32, author="Test Keeper")
