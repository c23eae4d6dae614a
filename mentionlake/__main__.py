import sys

from mentionlake.cli import main

sys.exit(main())
